"""The query catalogue: each query by name, and for most the SQL that gives the same rows in another engine.

Queries whose SQL is the same in Spark and elsewhere are written once, in `SHARED`, with tables in braces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import chunk, fusion, graph, ingest, lexical, vector
from lodestone.plans import adaptive
from lodestone.session import load, materialise, shared_folder
from lodestone.streaming import progress

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Token lists and BM25 parts, as common table expressions.
_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_BM25 = (
    f"toks AS (SELECT doc_id, source, {_TOK.format('text')} AS ts FROM documents), dl AS (SELECT doc_id, source, len(ts) AS dl FROM toks), tf AS (SELECT doc_id, source, term, count(*) AS tf FROM (SELECT doc_id, source, unnest(ts) AS term FROM toks) GROUP BY ALL), "
    f"q AS (SELECT DISTINCT item_id, unnest({_TOK.format('text')}) AS term FROM benchmark)"
)
_CORPUS = "st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"
_SCORE = "round(sum(ln(1+(n-df+0.5)/(df+0.5))*tf*2.2/(tf+1.2*(0.25+0.75*dl/avgdl))),6) AS score"
_SCORED = f"sc AS (SELECT item_id, tf.doc_id, {_SCORE} FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl ON dl.doc_id = tf.doc_id CROSS JOIN st {{}} GROUP BY item_id, tf.doc_id)"
_RANK = "row_number() OVER (PARTITION BY {0} ORDER BY score DESC, {1}) AS rank"
_BUCKET = "(('0x'||substr(md5({}),1,8))::BIGINT % 64)"


def _hashed(table: str, key: str) -> str:
    return (
        f"c_{table} AS (SELECT {key}, {_BUCKET.format('t')} AS bucket, count(*) AS c FROM (SELECT {key}, unnest({_TOK.format('text')}) AS t FROM {table}) GROUP BY ALL), "
        f"e_{table} AS (SELECT {key}, bucket, round(c / sqrt(sum(c*c) OVER (PARTITION BY {key})::DOUBLE), 9) AS w FROM c_{table})"
    )


_HYBRID = (
    f"WITH {_BM25}, {_CORPUS}, {_SCORED.format('')}, bl AS (SELECT * FROM (SELECT item_id, doc_id, {_RANK.format('item_id', 'doc_id')} FROM sc) WHERE rank <= 10), "
    f"{_hashed('documents', 'doc_id')}, {_hashed('benchmark', 'item_id')}, vs AS (SELECT item_id, doc_id, round(sum(d.w*b.w),6) AS score FROM e_documents d JOIN e_benchmark b USING (bucket) GROUP BY ALL), "
    f"vl AS (SELECT * FROM (SELECT item_id, doc_id, {_RANK.format('item_id', 'doc_id')} FROM vs) WHERE rank <= 10), "
    f"fu AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE/(60+rank)),6) AS score FROM (SELECT * FROM bl UNION ALL SELECT * FROM vl) GROUP BY ALL), fr AS (SELECT item_id, doc_id, score, {_RANK.format('item_id', 'doc_id')} FROM fu) "
)
_COS = "round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6)"


_SEMANTIC = (
    "WITH s0 AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '[。！？.\\n]') AS p FROM documents WHERE regexp_matches(text, '\\S'))), "
    "s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, trim(s) AS sentence FROM s0 WHERE trim(s) <> ''), "
    f"w AS (SELECT doc_id, pos, {_BUCKET.format('w')} AS b, count(*)::DOUBLE AS c FROM (SELECT doc_id, pos, unnest(string_split(sentence, ' ')) AS w FROM s) GROUP BY ALL), "
    "n AS (SELECT doc_id, pos, sqrt(sum(c*c)) AS norm FROM w GROUP BY ALL), dt AS (SELECT a.doc_id, a.pos, sum(a.c*b.c) AS dot FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.b = b.b AND b.pos = a.pos + 1 GROUP BY ALL), "
    "d AS (SELECT s.doc_id, s.pos, sentence, CASE WHEN m.norm IS NOT NULL THEN round(1 - coalesce(dot, 0) / (n.norm * m.norm), 9) END AS distance FROM s LEFT JOIN n ON n.doc_id = s.doc_id AND n.pos = s.pos LEFT JOIN n m ON m.doc_id = s.doc_id AND m.pos = s.pos + 1 LEFT JOIN dt ON dt.doc_id = s.doc_id AND dt.pos = s.pos), "
    "l AS (SELECT doc_id, quantile_cont(distance, 0.95) AS lim FROM d GROUP BY doc_id), c AS (SELECT d.doc_id, pos, sentence, coalesce((distance > lim)::INT, 0) AS cut FROM d JOIN l ON l.doc_id = d.doc_id), "
    "x AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS section FROM c), "
    "y AS (SELECT doc_id, section, string_agg(sentence, ' ' ORDER BY pos) AS chunk FROM x GROUP BY ALL) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1)::INT AS chunk_index, chunk FROM y"
)
_MARKDOWN = (
    "WITH t AS (SELECT page_id AS doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<h1[^>]*>', chr(10)||'# ', 'g'), '(?i)</h1>|</p>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)) AS p FROM pages), "
    "l AS (SELECT doc_id, generate_subscripts(p, 1) AS i, trim(unnest(p)) AS line FROM t), h AS (SELECT *, regexp_matches(line, '^#{1,6}\\s+\\S') AS header FROM l), "
    "x AS (SELECT *, sum(header::INT) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM h), y AS (SELECT doc_id, section, string_agg(line, chr(10) ORDER BY i) AS chunk FROM x WHERE NOT header AND line <> '' GROUP BY ALL) "
    "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1)::INT AS chunk_index, chunk FROM y"
)
_SUB = (
    "WITH p AS (SELECT item_id, unnest(q) AS s, generate_subscripts(q, 1) AS i FROM (SELECT item_id, regexp_split_to_array(text, '[.?;\\n]|,? and |,? or ') AS q FROM benchmark)), "
    "u AS (SELECT item_id, trim(s) AS s, min(i) AS i FROM p WHERE trim(s) <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS n FROM u) "
    "SELECT item_id, string_agg(s, '|' ORDER BY i) AS questions FROM r GROUP BY item_id"
)


def query(oracle: str | None = None):
    """Register a function (tables by name) -> DataFrame under its name, with its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: load(spark, sf_dir, name))

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def one(t, item: int = 0) -> DataFrame:
    return t("benchmark").where(F.col("item_id") == item)


# Retrieval


@query(f"WITH {_BM25}, {_CORPUS}, {_SCORED.format('WHERE item_id = 0')} SELECT item_id, doc_id, score, rank FROM (SELECT *, {_RANK.format('item_id', 'doc_id')} FROM sc) WHERE rank <= 10")
def q_bm25_topk(t):
    return lexical.bm25(t("documents"), one(t), 10)


@query(f"WITH {_BM25}, {_CORPUS}, {_SCORED.format('')} SELECT item_id, doc_id, score, rank FROM (SELECT *, {_RANK.format('item_id', 'doc_id')} FROM sc) WHERE rank <= 3")
def q_bm25_batch(t):
    return lexical.bm25(t("documents"), t("benchmark"), 3)


@query(f"WITH {_BM25}, s AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS ctf FROM tf GROUP BY term) SELECT term, df, ctf, round(ln(1+((SELECT count(*) FROM documents)-df+0.5)/(df+0.5)),6) AS idf FROM s ORDER BY df DESC, term LIMIT 50")
def q_term_stats(t):
    return lexical.term_stats(t("documents")).orderBy(F.desc("df"), "term").limit(50)


@query(f"WITH {_BM25} SELECT term, doc_id, tf FROM tf")
def q_postings(t):
    return lexical.postings(t("documents"))


def _vec(where: str, k: int, extra: str = "TRUE", cut: str = "TRUE") -> str:
    return f"WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS score FROM embeddings e, embeddings q WHERE {where} AND {extra}) SELECT * FROM (SELECT query_id, vec_id, score, {_RANK.format('query_id', 'vec_id')} FROM s WHERE {cut}) WHERE rank <= {k}"


@query(_vec("q.vec_id = 0", 10))
def q_vector_topk(t):
    return vector.search(t("embeddings"), t("embeddings").where("vec_id = 0"), 10)


@query(_vec("q.vec_id = 0", 10, "e.label = 2"))
def q_vector_filtered(t):
    return vector.search(t("embeddings").where("label = 2"), t("embeddings").where("vec_id = 0"), 10)


@query(_vec("q.vec_id = 0", 5, cut="score >= 0.3"))
def q_vector_threshold(t):
    return vector.search(t("embeddings"), t("embeddings").where("vec_id = 0"), 5, 0.3)


@query(_vec("q.vec_id % 20 = 0", 3))
def q_vector_batch(t):
    return vector.search(t("embeddings"), t("embeddings").where("vec_id % 20 = 0"), 3)


@query()
def q_vector_lsh(t):
    return vector.search_lsh(t("embeddings"), t("embeddings").where("vec_id % 20 = 0"), 10)


@query(f"WITH {_hashed('documents', 'doc_id')} SELECT doc_id, bucket::INT AS bucket, w FROM e_documents")
def q_hash_embed(t):
    return vector.hash_embed(t("documents"))


@query(_HYBRID + "SELECT item_id, doc_id, rank FROM fr WHERE item_id = 0 AND rank <= 4")
def q_hybrid_rrf(t):
    return fusion.hybrid(t("documents"), one(t)).select("item_id", "doc_id", "rank")


@query(_HYBRID + "SELECT item_id, doc_id, score, rank FROM fr WHERE rank <= 4")
def q_hybrid_scores(t):
    return fusion.hybrid(t("documents"), t("benchmark"))


_MULTI = f"WITH {_BM25}, {_CORPUS}, {_SCORED.format('WHERE item_id < 3')}, r AS (SELECT item_id AS question_ord, rank, doc_id AS pk FROM (SELECT *, {_RANK.format('item_id', 'doc_id')} FROM sc) WHERE rank <= 3) "


@query(_MULTI + "SELECT question_ord, rank, pk FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY question_ord, rank) AS n FROM r) WHERE n = 1")
def q_multi_query(t):
    hits = lexical.bm25(t("documents"), t("benchmark").where("item_id < 3"), 3)
    return fusion.multi_query(hits.select(F.col("item_id").alias("question_ord"), "rank", F.col("doc_id").alias("pk")))


@query(f"WITH {_BM25.replace('FROM documents', chr(70) + 'ROM documents WHERE source = ' + chr(39) + 'src1' + chr(39))}, {_CORPUS}, {_SCORED.format('WHERE item_id = 0')} SELECT item_id, doc_id, score, rank FROM (SELECT *, {_RANK.format('item_id', 'doc_id')} FROM sc) WHERE rank <= 4")
def q_tenant_topk(t):
    return lexical.bm25(t("documents").where("source = 'src1'"), one(t), 4)


# Chunks and pages


@query("SELECT doc_id, i::INT AS chunk_index, substr(text, (i*800+1)::BIGINT, 1000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(1, ceil((length(text)-200)/800.0))::BIGINT)) AS i FROM documents WHERE regexp_matches(text, '\\S'))")
def q_chunk_character(t):
    return chunk.character(t("documents"))


@query()
def q_chunk_recursive(t):
    return chunk.recursive(t("documents"))


@query(_SEMANTIC)
def q_chunk_semantic(t):
    return chunk.semantic(t("documents"))


@query(_MARKDOWN)
def q_chunk_markdown(t):
    marked = F.regexp_replace(F.regexp_replace("html", r"(?i)<h1[^>]*>", "\n# "), r"(?i)</h1>|</p>", "\n")
    return chunk.markdown(t("pages").select(F.col("page_id").alias("doc_id"), F.regexp_replace(marked, r"<[^>]*>", "").alias("text")))


@query()
def q_split_long(t):
    return chunk.long_split(t("documents"))


_CHAR = ORACLES["q_chunk_character"]


@query(f"WITH c AS ({_CHAR}) SELECT c.doc_id, 'doc-'||c.doc_id AS document_name, chunk_index, length(chunk)::INT AS chunk_size, count(*) OVER (PARTITION BY c.doc_id) AS total_chunks FROM c")
def q_chunk_metadata(t):
    names = t("documents").select("doc_id", F.concat(F.lit("doc-"), "doc_id").alias("document_name"))
    return chunk.with_metadata(chunk.character(t("documents")), names).drop("chunk")


@query("SELECT count(*) AS docs, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS blank FROM documents")
def q_chunk_blank(t):
    kept = chunk.not_blank(t("documents")).agg(F.count("*").alias("kept"))
    return t("documents").agg(F.count("*").alias("docs")).join(F.broadcast(kept)).select("docs", (F.col("docs") - F.col("kept")).alias("blank"))


_HTML = r"trim(regexp_replace(regexp_replace(regexp_replace({}, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'))"


@query(f"SELECT page_id, length(x)::INT AS n_chars, md5(x) AS digest FROM (SELECT page_id, {_HTML.format('html')} AS x FROM pages)")
def q_html_text(t):
    x = X.html_text("html")
    return t("pages").select("page_id", F.length(x).alias("n_chars"), F.md5(x).alias("digest"))


_BLOCKS = f"b AS (SELECT page_id, (generate_subscripts(p, 1) - 1)::INT AS pos, unnest(p) AS raw FROM (SELECT page_id, regexp_split_to_array(html, '(?i)</(?:p|div|li|h[1-6]|td|article|section|footer|nav|ul|script|style)>') AS p FROM pages)), bb AS (SELECT page_id, pos, raw, {_HTML.format('raw')} AS block FROM b)"


@query(f"WITH {_BLOCKS} SELECT page_id, pos, block, length(raw)::INT AS html_chars, length(block)::INT AS text_chars FROM bb WHERE length(block) > 0 AND length(block) >= 0.4 * length(raw)")
def q_prune_blocks(t):
    return ingest.prune_blocks(t("pages"))


@query()
def q_crawl_frontier(t):
    pages = t("pages")
    edges = ingest.links(pages)
    first = pages.agg(F.min(F.struct("page_id", "url"))["url"].alias("u")).first()
    return ingest.crawl_frontier(edges, first["u"] if first and first["u"] else "http://none")


@query(f"WITH {_BLOCKS} SELECT page_id, count(*) AS chunks, sum(length(block))::BIGINT AS chars FROM bb WHERE length(block) > 0 AND length(block) >= 0.4 * length(raw) GROUP BY page_id")
def q_ingest_pipeline(t):
    kept = ingest.number_chunks(ingest.prune_blocks(t("pages")).withColumnRenamed("page_id", "doc_id"))
    return kept.groupBy(F.col("doc_id").alias("page_id")).agg(F.count("chunk_id").alias("chunks"), F.sum("text_chars").alias("chars"))


@query(f"WITH {_BLOCKS} SELECT page_id, pos, block FROM bb WHERE length(block) > 0 AND NOT regexp_matches(raw, '(?i)<(nav|footer|aside|header|form)[ >]') AND NOT regexp_matches(raw, '(?i)^\\s*<(li|a)[ >]')")
def q_content_filter(t):
    return ingest.core_blocks(t("pages")).select("page_id", "pos", "block")


_SAVED = f"WITH c AS ({_CHAR.replace('FROM documents', 'FROM documents d0')}), k AS (SELECT source AS collection_id, count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM c JOIN documents USING (doc_id) GROUP BY source) "


@query(_SAVED + "SELECT collection_id, chunks, documents, 'character' AS strategy FROM k WHERE collection_id <> 'src1'")
def q_store_collections(t):
    """Chunks stored, one collection dropped, and what is read back from those that stay."""
    docs = t("documents")
    numbered = ingest.number_chunks(chunk.character(docs).withColumnRenamed("chunk_index", "pos").join(docs.select("doc_id", F.col("source").alias("collection_id")), "doc_id"))
    path = shared_folder(docs.sparkSession, "collections")
    ingest.write_collection(numbered, path, "overwrite")
    ingest.drop_collection(docs.sparkSession, path, "src1")
    stored = docs.sparkSession.read.parquet(path)
    return stored.groupBy("collection_id").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.lit("character").alias("strategy"))


@query(f"WITH c AS ({_CHAR}) SELECT source AS collection_id, count(*) AS total_chunks, count(DISTINCT doc_id) AS documents FROM c JOIN documents USING (doc_id) GROUP BY source")
def q_store_summary(t):
    c = chunk.character(t("documents")).join(t("documents").select("doc_id", F.col("source").alias("collection_id")), "doc_id")
    return c.groupBy("collection_id").agg(F.count("*").alias("total_chunks"), F.countDistinct("doc_id").alias("documents"))


# Graph

_ENT = f"{_BM25}, ents AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING length(term) >= 5 AND count(*) >= 3 AND count(*) <= 0.2 * (SELECT count(*) FROM documents))"
_SENT = f"ss AS (SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS s FROM (SELECT doc_id, regexp_split_to_array(text, '[。！？.\\n]') AS p FROM documents)), se AS (SELECT DISTINCT doc_id, pos, term FROM (SELECT doc_id, pos, unnest({_TOK.format('s')}) AS term FROM ss) JOIN ents USING (term))"
_EDGE = f"{_ENT}, {_SENT}, ed AS (SELECT a.term AS src, b.term AS dst, count(*) AS weight FROM se a JOIN se b ON a.doc_id = b.doc_id AND a.pos = b.pos AND a.term < b.term GROUP BY ALL HAVING count(*) >= 2)"


def _edges(t, question):
    """Entities of the kept graph, which the documents' tables share between queries, and the edges that a question touches."""
    store = kept_queries.graph_store(t)
    ents = materialise(store.entities(), "entities")
    return ents, materialise(store.edges_of(lexical.question_terms(question), ents=ents), "edges")


@query(f"WITH {_EDGE} SELECT src, dst, weight FROM ed")
def q_cooccurrence_edges(t):
    return kept_queries.graph_store(t).edges()


@query(f"WITH {_EDGE}, nd AS (SELECT src AS n FROM ed UNION SELECT dst FROM ed) SELECT (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM ed) AS edges, (SELECT count(DISTINCT substr(n,1,1)) FROM nd) AS labels")
def q_graph_stats(t):
    terms, pairs = kept_queries.graph_store(t).numbered_edges()
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("ends")).join(terms, "id")
    return ends.agg(F.count("*").alias("nodes"), F.coalesce(F.expr("sum(ends) div 2"), F.lit(0)).alias("edges"), F.countDistinct(F.substring("term", 1, 1)).alias("labels"))


_LOCAL = f"lo AS (SELECT item_id, doc_id, score, {_RANK.format('item_id', 'doc_id')} FROM (SELECT item_id, doc_id, round(sum(w),6)::DOUBLE AS score FROM (SELECT item_id, term, sum(weight) AS w FROM (SELECT item_id, dst AS term, weight FROM ed JOIN q ON src = q.term UNION ALL SELECT item_id, src, weight FROM ed JOIN q ON dst = q.term) GROUP BY ALL) JOIN tf USING (term) GROUP BY ALL))"
_GLOBAL = (
    "idf AS (SELECT term, ln((SELECT count(*) FROM documents) / df::DOUBLE) AS idf FROM ents), "
    "ht AS (SELECT DISTINCT item_id, src, dst, round(weight*(i1.idf+i2.idf),6) AS score FROM ed JOIN idf i1 ON src = i1.term JOIN idf i2 ON dst = i2.term JOIN q ON q.term = src OR q.term = dst), "
    "be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, src, dst) AS r FROM ht) WHERE r <= 20), "
    "et AS (SELECT item_id, term, sum(score) AS w FROM (SELECT item_id, src AS term, score FROM be UNION ALL SELECT item_id, dst, score FROM be) GROUP BY ALL), "
    f"gl AS (SELECT item_id, doc_id, score, {_RANK.format('item_id', 'doc_id')} FROM (SELECT item_id, doc_id, round(sum(w),6)::DOUBLE AS score FROM et JOIN tf USING (term) GROUP BY ALL))"
)


def _question(t):
    """A question for the graph: the text of the first document, which holds entities."""
    return t("documents").where("doc_id = 1").select(F.lit(0).cast("long").alias("item_id"), "text")


_Q0 = _EDGE.replace("FROM benchmark", "FROM (SELECT 0::BIGINT AS item_id, text FROM documents WHERE doc_id = 1)")


@query(f"WITH {_Q0}, {_LOCAL} SELECT item_id, doc_id, score, rank FROM lo WHERE rank <= 5")
def q_graph_local(t):
    ents, edges = _edges(t, _question(t))
    return graph.local_chunks(t("documents"), edges, ents, _question(t), 5)


@query(f"WITH {_Q0}, {_GLOBAL} SELECT item_id, doc_id, score, rank FROM gl WHERE rank <= 5")
def q_graph_global(t):
    ents, edges = _edges(t, _question(t))
    return graph.global_chunks(t("documents"), edges, ents, _question(t), 5)


@query(f"WITH {_Q0}, {_LOCAL}, {_GLOBAL}, il AS (SELECT item_id, doc_id, min(place) AS place FROM (SELECT item_id, doc_id, rank*2-1 AS place FROM lo WHERE rank <= 5 UNION ALL SELECT item_id, doc_id, rank*2 FROM gl WHERE rank <= 5) GROUP BY ALL) SELECT item_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY place) AS rank FROM il) WHERE rank <= 5")
def q_graph_hybrid(t):
    q = _question(t)
    ents, edges = _edges(t, q)
    return graph.interleave(graph.local_chunks(t("documents"), edges, ents, q, 5), graph.global_chunks(t("documents"), edges, ents, q, 5), 5)


_NAIVE = f"{_hashed('documents', 'doc_id')}, {_hashed('question', 'item_id')}, nv AS (SELECT item_id, doc_id, score, {_RANK.format('item_id', 'doc_id')} FROM (SELECT item_id, doc_id, round(sum(d.w*b.w),6) AS score FROM e_documents d JOIN e_question b USING (bucket) GROUP BY ALL))"
_ASKED = "question AS (SELECT 0::BIGINT AS item_id, text FROM documents WHERE doc_id = 1)"


@query(f"WITH {_ASKED}, {_NAIVE} SELECT item_id, doc_id, score, rank FROM nv WHERE rank <= 5")
def q_graph_naive(t):
    return vector.hash_search(t("documents"), _question(t), 5)


@query(f"WITH {_Q0}, {_ASKED}, {_NAIVE}, {_LOCAL}, {_GLOBAL}, il AS (SELECT item_id, doc_id, min(place) AS place FROM (SELECT item_id, doc_id, rank*2-1 AS place FROM lo WHERE rank <= 5 UNION ALL SELECT item_id, doc_id, rank*2 FROM gl WHERE rank <= 5) GROUP BY ALL), hy AS (SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY place) AS rank FROM il) WHERE rank <= 5), mx AS (SELECT item_id, doc_id, min(place) AS place FROM (SELECT item_id, doc_id, rank*2-1 AS place FROM hy UNION ALL SELECT item_id, doc_id, rank*2 FROM nv WHERE rank <= 5) GROUP BY ALL) SELECT item_id, doc_id, rank FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY place) AS rank FROM mx) WHERE rank <= 5")
def q_graph_mix(t):
    q = _question(t)
    ents, edges = _edges(t, q)
    of_graph = graph.interleave(graph.local_chunks(t("documents"), edges, ents, q, 5), graph.global_chunks(t("documents"), edges, ents, q, 5), 5)
    return graph.interleave(of_graph, vector.hash_search(t("documents"), q, 5), 5)


@query(
    "WITH RECURSIVE bo AS (SELECT DISTINCT * FROM (SELECT 'c'||o_custkey AS s, 'p'||o_orderpriority AS d FROM orders UNION ALL SELECT 'p'||o_orderpriority, 'c'||o_custkey FROM orders)), "
    "start AS (SELECT min(s) AS s FROM bo WHERE s LIKE 'c%'), w AS (SELECT s AS node, 0 AS depth FROM start UNION SELECT bo.d, depth + 1 FROM w JOIN bo ON bo.s = w.node WHERE depth < 3), "
    "m AS (SELECT node, min(depth) AS depth FROM w GROUP BY node) SELECT node, depth::INT AS depth, (SELECT count(*) FROM m) > 1000 AS is_truncated FROM m ORDER BY depth, node LIMIT 1000"
)
def q_bfs_subgraph(t):
    e = t("orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "o_orderpriority").alias("dst"))
    start = e.agg(F.min("src")).first()[0]
    return graph.bfs(e, start or "")


# One text for both engines

SHARED = {
    "q_graph_render": "SELECT n_nationkey AS id, coalesce(nullif(n_name, ''), cast(n_nationkey AS VARCHAR(20))) AS name, coalesce(nullif(r_name, ''), 'Unknown') AS category, CASE WHEN n_regionkey IS NULL THEN 'RELATED' ELSE 'IN' END AS edge_name, least(greatest(cast(floor(length(n_name) / 10.0) AS INT), 20), 80) AS size FROM {nation} n LEFT JOIN {region} r ON n_regionkey = r_regionkey",
    "q_crawl_skip": "SELECT page_id, url FROM {pages} WHERE html IS NOT NULL AND trim(html) <> ''",
    "q_url_prefix": "SELECT page_id, url FROM {pages} WHERE url LIKE 'https://www.%'",
    "q_url_parts": "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^([^?#]*/)', 1) AS prefix, regexp_extract(url, '^([^?#]*)', 1) AS bare, regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) AS base FROM {pages}",
    "q_url_dedup": "SELECT min(page_id) AS page_id, regexp_extract(url, '^([^?#]*)', 1) AS bare, count(*) AS times FROM {pages} GROUP BY regexp_extract(url, '^([^?#]*)', 1)",
    "q_collection_id": "SELECT c_custkey, concat('kb', c_custkey, '_', 1700000000000 + c_custkey) AS collection_id, md5(concat(c_custkey, '-', 0)) AS chunk_id FROM {customer}",
    "q_active_libraries": "SELECT c_custkey, c_name FROM {customer} WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING' AND c_acctbal > 0",
    "q_filter_or": "SELECT c_custkey, c_name FROM {customer} WHERE c_name = 'Customer#000000007' OR c_acctbal > 9000",
    "q_partial_update": "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN concat(c_name, '-new') END, c_name) AS c_name, coalesce(CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 END, c_acctbal) AS c_acctbal FROM {customer}",
    "q_soft_delete": "SELECT c_custkey, c_name, NOT (c_acctbal < 0) AS is_active FROM {customer}",
    "q_insert_if_absent": "WITH old AS (SELECT c_name AS title, c_nationkey AS owner FROM {customer} WHERE c_custkey % 2 = 0), new AS (SELECT c_custkey, c_name AS title, c_nationkey AS owner FROM {customer}) SELECT c_custkey, title, owner FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.title = new.title AND old.owner = new.owner)",
    "q_title_rule": "SELECT conv_id, turn, CASE WHEN length(trim(text)) > 50 THEN concat(substr(trim(text), 1, 50), '...') ELSE trim(text) END AS title, substr(trim(text), 1, 100) AS renamed FROM {conversations} WHERE role = 'user'",
    "q_doc_permission": "SELECT o_orderkey, o_custkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE c_nationkey = 5 AND c_acctbal > 0",
    "q_library_doc_count": "SELECT c_custkey, count(o_orderkey) AS documents FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY c_custkey",
    "q_duplicate_titles": "SELECT a.o_orderkey FROM {orders} a WHERE EXISTS (SELECT 1 FROM {orders} b WHERE b.o_custkey = a.o_custkey AND b.o_orderpriority = a.o_orderpriority AND b.o_orderstatus = a.o_orderstatus AND b.o_orderkey <> a.o_orderkey)",
    "q_cascade_delete": "SELECT conv_id, turn, role FROM {conversations} c WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT conv_id FROM {conversations} WHERE conv_id % 5 = 0) d WHERE d.conv_id = c.conv_id)",
    "q_existing_conversations": "SELECT event_id, user_id FROM {events} e WHERE EXISTS (SELECT 1 FROM {conversations} c WHERE c.conv_id = e.user_id)",
    "q_conv_count": "SELECT user_id, count(*) AS n FROM {events} WHERE event_type = 'view' GROUP BY user_id",
    "q_message_count": "SELECT conv_id, count(*) AS messages FROM {conversations} GROUP BY conv_id",
    "q_type_distribution": "SELECT coalesce(lang, 'unknown') AS type, count(*) AS n FROM {documents} GROUP BY coalesce(lang, 'unknown')",
    "q_conv_page": "SELECT o_orderkey, o_custkey FROM {orders} WHERE o_custkey = (SELECT min(o_custkey) FROM {orders}) ORDER BY o_orderdate DESC, o_orderkey LIMIT 5 OFFSET 1",
    "q_message_page": "SELECT conv_id, turn, role, text FROM {conversations} ORDER BY conv_id, turn LIMIT 100 OFFSET 20",
    "q_libraries_ordered": "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM (SELECT c_custkey, c_acctbal FROM {customer} ORDER BY c_acctbal DESC, c_custkey LIMIT 100) x",
    "q_history_search": "SELECT conv_id, turn FROM {conversations} WHERE lower(text) LIKE '%the%' AND role = 'user'",
    "q_history_range": "SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1998-07-31 00:00:00' THEN 'today' WHEN o_orderdate >= TIMESTAMP '1998-07-25 00:00:00' THEN '7 days' WHEN o_orderdate >= TIMESTAMP '1998-06-30 00:00:00' THEN '1 month' ELSE 'older' END AS age FROM {orders}",
    "q_history_replay": "SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'node_update' ELSE role END AS kind, text FROM {conversations}",
    "q_role_filter": "SELECT conv_id, turn, lower(role) AS role FROM {conversations} WHERE lower(role) IN ('user', 'assistant', 'system')",
    "q_validate_requests": "SELECT conv_id, turn, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(trim(text)) > 10000 THEN 'too long' WHEN conv_id IS NULL THEN 'no user' ELSE 'valid' END AS verdict FROM {conversations}",
    "q_last_assistant": "SELECT conv_id, turn, text FROM (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM {conversations} WHERE role = 'assistant') x WHERE n = 1",
    "q_latest_dialog": "SELECT conv_id, turn, role, text FROM {conversations} WHERE conv_id = (SELECT max(conv_id) FROM {conversations}) AND role IN ('user', 'assistant')",
    "q_trim_history": "SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM {conversations}) x WHERE n <= 20",
    "q_state_history": "SELECT conv_id, turn, role, parent FROM (SELECT conv_id, turn, role, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM {conversations}) x WHERE n <= 10",
    "q_node_update_text": "SELECT event_id, CASE event_type WHEN 'view' THEN 'checking whether to retrieve' WHEN 'click' THEN 'expanding the question' WHEN 'purchase' THEN 'retrieving' WHEN 'signup' THEN 'answering' ELSE 'failed' END AS content FROM {events}",
    "q_session_status": "SELECT user_id, count(*) AS events, CASE WHEN sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) > 0 THEN 'error' WHEN sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) > 0 THEN 'complete' ELSE 'open' END AS status FROM {events} GROUP BY user_id",
    "q_crawl_counter": "SELECT user_id AS collection_id, count(*) AS pages FROM {events} WHERE event_type = 'view' GROUP BY user_id",
    "q_point_lookup": "SELECT c_custkey, c_name FROM {customer} WHERE c_custkey = 7 LIMIT 1",
    "q_page_guards": "SELECT event_id, CASE WHEN a > 0 AND a <= 100 THEN a ELSE 50 END AS page_limit, CASE WHEN b < 0 THEN 0 ELSE b END AS page_offset FROM (SELECT event_id, event_id % 150 - 20 AS a, event_id % 30 - 10 AS b FROM {events}) x",
    "q_collection_library": "SELECT doc_id, c_custkey, c_name FROM {documents} JOIN {customer} ON source = concat('src', c_custkey)",
    "q_sort_by_date": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM (SELECT o_orderkey, o_orderdate FROM {orders} ORDER BY o_orderdate DESC, o_orderkey LIMIT 50) x",
    "q_sort_by_title": "SELECT c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) AS place FROM (SELECT c_custkey, c_name FROM {customer} ORDER BY c_name, c_custkey LIMIT 50) x",
    "q_sorted_labels": "SELECT DISTINCT lang AS label FROM {documents} WHERE lang IS NOT NULL ORDER BY label",
    "q_name_index": "SELECT concat('doc-', doc_id) AS document_name, count(*) AS n, min(doc_id) AS doc_id FROM {documents} GROUP BY concat('doc-', doc_id)",
    "q_save_message": "SELECT conv_id, turn, role, text FROM {conversations} UNION ALL SELECT conv_id, max(turn) + 1 AS turn, 'user' AS role, 'a new message' AS text FROM {conversations} GROUP BY conv_id",
    "q_conversation_create": "SELECT conv_id, CASE WHEN length(trim(text)) > 50 THEN concat(substr(trim(text), 1, 50), '...') ELSE trim(text) END AS title, turns FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS turns FROM {conversations} WHERE role = 'user') x WHERE n = 1",
    "q_conversation_touch": "SELECT conv_id, turn, CASE WHEN turn = (max(turn) OVER (PARTITION BY conv_id)) THEN 1 ELSE 0 END AS is_latest FROM {conversations}",
    "q_user_conversations_delete": "SELECT event_id, user_id FROM {events} WHERE user_id NOT IN (SELECT c_custkey FROM {customer} WHERE c_acctbal < 0)",
    "q_document_upsert": "SELECT doc_id, source, length(text) AS size, 'kept' AS state FROM {documents} WHERE doc_id NOT IN (SELECT page_id FROM {pages}) UNION ALL SELECT page_id AS doc_id, url AS source, length(html) AS size, CASE WHEN d.doc_id IS NULL THEN 'added' ELSE 'updated' END AS state FROM {pages} p LEFT JOIN {documents} d ON d.doc_id = p.page_id",
    "q_library_update": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM {customer} o WHERE o.c_name = 'Customer#000000009' AND o.c_nationkey = c.c_nationkey AND o.c_custkey <> c.c_custkey) THEN 'Customer#000000009' ELSE c_name END AS title FROM {customer} c",
    "q_start_defaults": "SELECT conv_id, turn, coalesce(nullif(trim(text), ''), 'no question') AS question, CASE WHEN role = 'system' THEN 'no_retrieval' ELSE 'auto' END AS retrieval_mode, CASE WHEN turn > 0 AND turn <= 20 THEN turn ELSE 3 END AS max_retrieval_docs FROM {conversations}",
    "q_dialog_pairs": "SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM {conversations}",
}


def _shared(name: str, sql: str) -> None:
    used = [t for t in TABLES if "{" + t + "}" in sql]
    QUERIES[name] = lambda spark, sf_dir: spark.sql(sql, **{t: load(spark, sf_dir, t) for t in used})
    ORACLES[name] = sql.format(**{t: t for t in used})


for _name, _sql in SHARED.items():
    _shared(_name, _sql)


# Scalars, history and events


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages")
def q_doc_basename(t):
    return t("pages").select("page_id", X.basename("url").alias("name"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def q_json_extract(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS local_time FROM events")
def q_tz_format(t):
    return t("events").select("event_id", F.date_format(F.from_utc_timestamp("ts", "Asia/Shanghai"), "yyyy-MM-dd HH:mm:ss").alias("local_time"))


@query("SELECT o_orderkey, CASE WHEN d >= 365 THEN (d // 365)||' years ago' WHEN d >= 30 THEN (d // 30)||' months ago' WHEN d >= 1 THEN d||' days ago' ELSE 'today' END AS age FROM (SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-08-02') AS d FROM orders)")
def q_relative_age(t):
    d = F.datediff(F.lit("1998-08-02").cast("date"), F.col("o_orderdate").cast("date"))
    age = F.when(d >= 365, F.concat(F.floor(d / 365), F.lit(" years ago"))).when(d >= 30, F.concat(F.floor(d / 30), F.lit(" months ago"))).when(d >= 1, F.concat(d, F.lit(" days ago"))).otherwise("today")
    return t("orders").select("o_orderkey", age.alias("age"))


@query("SELECT c_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS documents FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def q_library_nested(t):
    held = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("d"))
    joined = t("customer").join(held, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("c_custkey", F.when(F.col("d").isNotNull(), F.array_join(F.col("d").cast("array<string>"), ",")).alias("documents"))


@query("SELECT event_type, count(*) AS total, count(*) FILTER (WHERE ts::DATE = (SELECT max(ts::DATE) FROM events)) AS today FROM events GROUP BY event_type")
def q_today_count(t):
    last = t("events").agg(F.max(F.to_date("ts")).alias("d"))
    return t("events").join(F.broadcast(last)).groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(F.to_date("ts") == F.col("d")).alias("today"))


@query("SELECT n_name, (list_reduce(list_prepend(0::BIGINT, list_transform(string_split(n_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: ((h*31+c+2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)).abs()::BIGINT % 10 AS bucket FROM nation")
def q_label_bucket(t):
    return t("nation").select("n_name", X.label_bucket("n_name").cast("long").alias("bucket"))


@query("SELECT conv_id, turn, split_part('head-----Document Chunks(DC)-----'||text, '-----Document Chunks(DC)-----', 2) AS context FROM conversations")
def q_marker_split(t):
    whole = F.concat(F.lit("head-----Document Chunks(DC)-----"), "text")
    return t("conversations").select("conv_id", "turn", F.split_part(whole, F.lit("-----Document Chunks(DC)-----"), F.lit(2)).alias("context"))


@query(_SUB)
def q_clean_subquestions(t):
    return adaptive.expand(t("benchmark")).select("item_id", F.array_join("subquestions", "|").alias("questions"))


@query(_SUB.replace("string_agg(s, '|' ORDER BY i) AS questions", "first(s ORDER BY i) AS question"))
def q_graph_question(t):
    return adaptive.graph_question(adaptive.expand(t("benchmark"))).select("item_id", F.col("graph_question").alias("question"))


@query("SELECT item_id, length(text) > 40 AS need_retrieval, text AS extracted_question FROM benchmark")
def q_structured_decision(t):
    answers = t("benchmark").select("item_id", F.to_json(F.struct((F.length("text") > 40).alias("need_retrieval"), F.col("text").alias("extracted_question"))).alias("answer"))
    return adaptive.structured(answers, "need").select("item_id", "answer.need_retrieval", "answer.extracted_question")


@query(f"SELECT item_id, len({_TOK.format('text')}) >= 3 AND NOT regexp_full_match(text, '[0-9+*/(). -]+') AS need_retrieval FROM benchmark")
def q_route_need(t):
    return adaptive.need(t("benchmark")).select("item_id", "need_retrieval")


@query(r"SELECT item_id, CASE WHEN regexp_matches(lower(text), '\b(relation|relationship|between|connect|connection|compare|link)') THEN 'graph_only' ELSE 'vector_only' END AS retrieval_type FROM benchmark")
def q_route_type(t):
    return adaptive.classify(t("benchmark")).select("item_id", "retrieval_type")


@query(_HYBRID + "SELECT item_id, string_agg('[document '||rank||' - '||source||'] '||text, chr(10) ORDER BY rank) AS context, count(*) AS documents FROM fr JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY item_id")
def q_prompt_assembly(t):
    hits = fusion.hybrid(t("documents"), t("benchmark"), 3)
    return adaptive.assemble(hits, t("documents").select("doc_id", "source", "text"))


@query("SELECT item_id, 'Answer from general knowledge.'||chr(10)||'Question: '||text AS prompt FROM benchmark")
def q_prompt_direct(t):
    return adaptive.direct_prompt(t("benchmark")).select("item_id", "prompt")


@query("SELECT event_id, 'data: {\"type\":\"'||event_type||'\",\"session_id\":'||user_id||',\"seq\":'||event_id||'}'||chr(10)||chr(10) AS line FROM events")
def q_sse_encode(t):
    return progress.sse_encode(t("events").select("event_id", F.col("event_type").alias("type"), F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"))).select("event_id", "line")


@query("SELECT event_id AS seq, user_id AS session_id, event_type AS type FROM events")
def q_sse_parse(t):
    lines = progress.sse_encode(t("events").select("event_id", F.col("event_type").alias("type"), F.col("user_id").alias("session_id"), F.col("event_id").alias("seq")))
    return progress.sse_parse(lines.select("line")).select("seq", "session_id", "type")


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS answer FROM conversations GROUP BY conv_id")
def q_token_concat(t):
    pieces = F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("piece"))))
    return t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(pieces, lambda x: x["piece"]), "").alias("answer"))


_STATUS = "SELECT user_id AS collection_id, count(*) FILTER (WHERE event_type = 'view') AS count, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'error' WHEN count(*) FILTER (WHERE event_type = 'purchase') > 0 THEN 'completed' ELSE 'processing' END AS status, arg_max(event_type, (ts, event_id)) AS message, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_time, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_update FROM events GROUP BY user_id"


@query(_STATUS.replace("arg_max(event_type, (ts, event_id))", "last(event_type ORDER BY ts, event_id)"))
def q_crawl_status(t):
    s = progress.crawl_status(t("events"))
    return s.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start_time", "last_update")})


def _at(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_tumbling(t):
    return progress.windowed(t("events"), "1 day").select(_at("window.start").alias("start"), "event_type", "n", "total")


@query("SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT date_trunc('day', ts) - INTERVAL 1 DAY * unnest([0, 1]) AS s, event_type, value FROM events) GROUP BY ALL")
def q_sliding(t):
    return progress.windowed(t("events"), "2 days", "1 day").select(_at("window.start").alias("start"), "event_type", "n", "total")


@query(
    "WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 DAY OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS fresh FROM events), "
    "s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k"
)
def q_session(t):
    return progress.sessions(t("events"), "1 day").select("user_id", _at("session.start").alias("start"), "n")


# Streaming jobs; each takes all input there is and ends


def _job(name: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark, f"{sf_dir}/events.parquet")
        return f

    return add


@_job("st_crawl_status")
def st_crawl_status(spark: SparkSession, path: str) -> DataFrame:
    """Status rows by epoch in a shared folder; the latest of each collection."""
    out = shared_folder(spark, "status")
    stream = progress.stream_crawl_status(progress.read_events(spark, path, 1000))
    progress.drain(stream, lambda df, epoch: progress.upsert_status(spark, out, df, epoch))
    return progress.read_status(spark, out)


ORACLES["st_crawl_status"] = "SELECT collection_id, count, status, message FROM (" + ORACLES["q_crawl_status"] + ")"


@_job("st_windows")
def st_windows(spark: SparkSession, path: str) -> DataFrame:
    """Closed day windows, as a watermark of a day lets them go."""
    out = shared_folder(spark, "windows")
    stream = progress.windowed(progress.read_events(spark, path, 1000).withWatermark("ts", "1 day"), "1 day")
    progress.drain(stream, lambda df, epoch: progress.upsert_status(spark, out, df, epoch), "append")
    return spark.read.parquet(out).select(_at("window.start").alias("start"), "event_type", "n", "total")


@_job("st_pages")
def st_pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawled pages as they come; those without text are skipped."""
    out = shared_folder(spark, "pages")
    stream = progress.read_pages(spark, path.replace("events.parquet", "pages.parquet"))
    progress.drain(stream, lambda df, epoch: progress.upsert_status(spark, out, df, epoch), "append")
    return spark.read.parquet(out).select("page_id", "url", F.length("html").alias("size"))


ORACLES["st_pages"] = "SELECT page_id, url, length(html) AS size FROM pages WHERE html IS NOT NULL AND trim(html) <> ''"


@_job("st_dedup")
def st_dedup(spark: SparkSession, path: str) -> DataFrame:
    """Events once each."""
    out = shared_folder(spark, "events")
    progress.drain(progress.stream_dedup(progress.read_events(spark, path, 1000), "365 days"), lambda df, epoch: progress.upsert_status(spark, out, df, epoch), "append")
    return spark.read.parquet(out).drop("epoch").select("event_id", "user_id", "event_type")


ORACLES["st_dedup"] = "SELECT DISTINCT event_id, user_id, event_type FROM events"
ORACLES["st_windows"] = (
    "SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT date_trunc('day', ts) AS s, event_type, value FROM events) "
    "WHERE s + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL"
)

# Queries over kept indexes, written tables and run state register themselves here
from lodestone import kept_queries  # noqa: E402, F401

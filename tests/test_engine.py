"""Golden and property tests of chunkers, graph, plan, sources and streams."""

import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.functions import table_functions
from lodestone.operators import chunk, fusion, graph, ingest, lexical, vector
from lodestone.plans import adaptive
from lodestone.queries import QUERIES
from lodestone.sources import files
from lodestone.streaming import progress


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def chunks(df):
    return [(r.doc_id, r.chunk) for r in df.orderBy("doc_id", "chunk_index").collect()]


def test_character_chunks_cover_the_text(spark):
    texts = ["", "  \n", None, "abc", "x" * 1000, "".join(chr(97 + i % 26) for i in range(2345))]
    got = chunks(chunk.character(docs(spark, *texts), 1000, 200))
    for d, t in enumerate(texts):
        mine = [c for i, c in got if i == d]
        if not t or not t.strip():
            assert mine == []
        else:
            assert mine[0] + "".join(c[200:] for c in mine[1:]) == t
            assert all(len(c) <= 1000 for c in mine)


def test_chunks_go_back_in_small_frames(monkeypatch):
    monkeypatch.setattr(chunk, "FRAME", 1000)
    batch = chunk.pd.DataFrame({"doc_id": range(50), "text": [f"{i} " * 200 for i in range(50)]})
    split = lambda t: chunk.split_recursive(t, 100, 20)
    frames = list(chunk._frames(batch, split))
    assert len(frames) > 10 and all(f["chunk"].str.len().sum() < 1100 for f in frames)
    assert [tuple(r) for f in frames for r in f.itertuples(index=False)] == [(d, i, c) for d, t in zip(batch["doc_id"], batch["text"]) for i, c in enumerate(split(t))]


def test_recursive_split_keeps_everything_within_size():
    text = "para one. words here\n\npara two，more words。end " * 30 + "x" * 500
    for size, overlap in ((50, 0), (50, 20), (200, 50)):
        got = chunk.split_recursive(text, size, overlap)
        assert all(len(c) <= size for c in got)
        if not overlap:
            assert "".join(got) == text


def test_long_split_does_not_repeat_a_flushed_sentence():
    long = "y" * 250
    text = "Short one. " + long + ". Tail." + "\n\n" + "Next paragraph."
    got = chunk.split_long(text, 100)
    assert all(len(c) <= 100 for c in got)
    assert sum(c.count("Short one") for c in got) == 1
    assert "".join(got).replace("\n", "").count("y") == 250
    assert chunk.split_long("z" * 6000) == ["z" * 6000]


def test_markdown_sections(spark):
    text = "intro\n    # One\na\n\nb\n## Two\n### Empty\n```\n# not a header\n```\n###### Six\nlast"
    assert [c for _, c in chunks(chunk.markdown(docs(spark, text)))] == ["intro", "a\nb", "```\n# not a header\n```", "last"]


def test_semantic_chunks_keep_sentences(spark):
    text = "a b c. a b c. a b c. x y z. x y z. x y z"
    got = [c for _, c in chunks(chunk.semantic(docs(spark, text), 0.8))]
    assert got == ["a b c a b c a b c", "x y z x y z x y z"]


def test_chunk_config_rejects():
    with pytest.raises(ValueError):
        chunk.ChunkConfig(strategy="magic")
    with pytest.raises(ValueError):
        chunk.ChunkConfig(size=100, overlap=100)


def test_bfs_on_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("z", "z")], "src string, dst string")
    got = {(r.node, r.depth) for r in graph.bfs(e, "a", 3).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)}
    capped = graph.bfs(e, None, cap=3).collect()
    assert len(capped) == 3 and all(r.is_truncated for r in capped)


def test_crawl_frontier(spark):
    rows = [("http://a/x/1", "http://a/x/2"), ("http://a/x/2", "http://a/x/3"), ("http://a/x/2", "http://b/x/3"), ("http://a/x/2", "http://a/y/9"), ("http://a/x/3", "http://a/x/1")]
    e = spark.createDataFrame(rows, "src_url string, dst_url string")
    got = [(r.url, r.depth) for r in ingest.crawl_frontier(e, "http://a/x/1", "http://a/x/").collect()]
    assert got == [("http://a/x/1", 0), ("http://a/x/2", 1), ("http://a/x/3", 2)]
    assert len(ingest.crawl_frontier(e, "http://a/x/1").collect()) == 4


def test_multi_query_keeps_keyless_rows(spark):
    hits = spark.createDataFrame([(0, 1, "a"), (0, 2, None), (1, 1, "a"), (1, 2, "b"), (1, 3, None)], "question_ord int, rank int, pk string")
    got = sorted((r.question_ord, r.rank, r.pk) for r in fusion.multi_query(hits).collect() if r.pk)
    assert got == [(0, 1, "a"), (1, 2, "b")] and fusion.multi_query(hits).count() == 4


def test_plan_routes_every_question_once(spark):
    q = spark.createDataFrame([(0, "what is the relation between a and b"), (1, "1 + 1"), (2, "tell me about x and y"), (3, " ")], "item_id long, text string")
    got = {r.item_id: r for r in adaptive.classify(adaptive.need(adaptive.expand(q))).collect()}
    assert got[0].retrieval_type == "graph_only" and got[2].retrieval_type == "vector_only"
    assert not got[1].need_retrieval and got[2].subquestions == ["tell me about x", "y"] and got[3].subquestions == []
    d = spark.createDataFrame([(7, "s", "words")], "doc_id long, source string, text string")
    hit = lambda qs: qs.select("item_id", F.lit(7).cast("long").alias("doc_id"), F.lit(1).alias("rank"))
    prompts = {r.item_id: r.prompt for r in adaptive.run(q, hit, hit, d).collect()}
    assert set(prompts) == {0, 1, 2, 3} and "[document 1 - s] words" in prompts[0] and "general knowledge" in prompts[1]


def test_models_are_injected(spark):
    adaptive.register_model("test:echo-1", lambda: lambda prompts: [p.upper() for p in prompts])
    q = spark.createDataFrame([(0, "hello")], "item_id long, prompt string")
    assert adaptive.ask(q, adaptive._models["test:echo_1"]).first().answer == "HELLO"
    with pytest.raises(KeyError):
        adaptive.model("test:none")
    with pytest.raises(ValueError):
        adaptive.register_model("plain", lambda: None)


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\ntext", encoding="utf-8")
    (tmp_path / "b.txt").write_text("plain ü", encoding="utf-8")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "d.pdf").write_bytes(b"p1|p2")
    got = {r.document_name: r.content for r in files.read_documents(spark, str(tmp_path), {"pdf": files.pdf_reader(lambda b: b.decode().split("|"))}).collect()}
    assert got == {"a.md": "# Title\ntext", "b.txt": "plain ü", "c.docx": "one\ntwo", "d.pdf": "p1p2"}
    with pytest.raises(Exception, match="no reader"):
        files.read_documents(spark, str(tmp_path)).collect()


def test_collections_round_trip(spark, tmp_path):
    c = spark.createDataFrame([(1, 0, "a", "k1"), (2, 0, "b", "k2")], "doc_id long, pos int, chunk string, collection_id string")
    path = str(tmp_path / "chunks")
    ingest.write_collection(ingest.number_chunks(c), path, "overwrite")
    ingest.write_collection(ingest.number_chunks(c.where("doc_id = 2")), path)
    assert ingest.read_collection(spark, path, "k2").count() == 2
    assert ingest.delete_documents(ingest.read_collection(spark, path, "k1"), spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_sse_skips_malformed_lines(spark):
    lines = spark.createDataFrame([('data: {"type":"token","session_id":1,"seq":2}\n\n',), ("data: {broken",), (": comment",)], "line string")
    assert [tuple(r) for r in progress.sse_parse(lines).collect()] == [("token", 1, 2)]


def test_streams_equal_their_batch_twins(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path = str(tmp_path / "events")
    events.repartition(3).write.parquet(path)
    q = progress.start(progress.stream_crawl_status(progress.read_events(spark, path)), "status")
    q.processAllAvailable()
    q.stop()
    streamed = {(r.collection_id, r["count"], r.status, r.message) for r in spark.table("status").collect()}
    batch = {(r.collection_id, r["count"], r.status, r.message) for r in progress.crawl_status(events.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    assert batch <= streamed  # update mode also holds the earlier states
    q = progress.start(progress.windowed(progress.read_events(spark, path), "1 day"), "win", "complete")
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("win").collect()} == {tuple(r) for r in progress.windowed(events.withColumn("ts", F.col("ts").cast("timestamp")), "1 day").collect()}
    q = progress.start(progress.stream_dedup(progress.read_events(spark, path), "100 days"), "once", "append")
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == events.select("event_id").distinct().count()


def test_lsh_search_asks_a_twentieth_of_all_vectors_and_recalls_them(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = {(r.query_id, r.vec_id) for r in vector.search(e, e.where("vec_id % 20 = 0"), 10).collect()}
    got = {(r.query_id, r.vec_id) for r in QUERIES["q_vector_lsh"](spark, "/root/testdata/sf0.01").collect()}
    assert {q for q, _ in got} == {r.vec_id for r in e.collect() if r.vec_id % 20 == 0}
    assert len(got & want) >= 0.9 * len(want)


def test_sign_search_scores_few_pairs(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    q = e.where("vec_id % 20 = 0")
    want = {(r.query_id, r.vec_id) for r in vector.search(e, q, 10).collect()}
    got = {(r.query_id, r.vec_id) for r in vector.search_lsh(e, q, 10).collect()}
    assert len(got & want) >= 0.9 * len(want)
    every = {(r.query_id, r.vec_id) for r in vector.search_lsh(e, q, e.count()).collect()}
    assert len(every) <= 0.25 * q.count() * e.count()


def test_searches_in_blocks_are_those_in_one(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = e.where("vec_id % 20 = 0")
    assert sorted(vector.search(e, q, 3, block=4).collect()) == sorted(vector.search(e, q, 3).collect())
    d, b = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "benchmark"))
    assert sorted(vector.hash_search(d, b, 3, block=7).collect()) == sorted(vector.hash_search(d, b, 3).collect())
    assert vector.hash_search(d, b.where("false"), 3).count() == 0 and vector.search_lsh(e.where("false"), q.where("false"), 3).count() == 0


def test_search_by_matrix_is_that_by_expressions_and_pairs_no_rows_in_plans(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    odd = spark.sql("select 9000L as vec_id, array_repeat(0f, 64) as embedding union all select 9001L, null union all select 9020L, array_repeat(0f, 64)")
    v = e.unionByName(odd)
    q = v.where("vec_id % 20 = 0")
    for k, threshold in ((3, None), (600, None), (5, 0.3)):
        pairs = v.crossJoin(q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))).select("query_id", "vec_id", vector.cosine("embedding", "q").alias("score"))
        want = lexical.top_k(pairs if threshold is None else pairs.where(F.col("score") >= threshold), "query_id", k, "vec_id")
        got = vector.search(v, q, k, threshold)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in vector.search_lsh(v, q, 3)._jdf.queryExecution().optimizedPlan().toString()


def test_long_split_breaks_at_paragraphs_stops_and_anywhere():
    text = "a" * 50 + "\n\n" + "b" * 40 + "\n\n" + "One two. " * 20 + "\n\n" + "x" * 250 + "\n\n" + "tail"
    got = chunk.split_long(text, 100)
    assert got[0] == "a" * 50 + "\n\n" + "b" * 40 and all(0 < len(c) <= 100 for c in got)
    assert "".join(got).replace("\n", "") == text.replace("\n", "")
    assert chunk.split_long("\u00a0" * 7000) == []


def test_collections_end_to_end(spark, tmp_path):
    path = str(tmp_path / "store")
    d = docs(spark, "# A\none\n# B\n" + "y" * 250, "plain", None)
    got = ingest.store(d, path, "k1", chunk.ChunkConfig("markdown"), limit=100)
    assert got == {"collection_id": "k1", "chunks": 5, "documents": 2, "strategy": "markdown"}
    assert [c for i, c in chunks(ingest.load_collection(spark, path, "k1")) if i == 0] == ["one", "y" * 100, "y" * 100, "y" * 50]
    assert ingest.drop_workspace(spark, {"a": path, "b": str(tmp_path / "none"), "c": "bad://x"}, "k1") | {"c": ""} == {"a": "success", "b": "warning", "c": ""}
    assert ingest.drop_collection(spark, path, "k1") == "warning"
    assert chunk.clear_metadata(chunk.with_metadata(chunk.character(d), d.select("doc_id", F.lit("n").alias("document_name")))).columns == ["doc_id", "chunk_index", "chunk"]


def test_retrievers_and_failures(spark):
    d = docs(spark, "red apples", "green pears", "red pears")
    q = spark.createDataFrame([(0, "red apples")], "item_id long, text string")
    for kind in ("similarity", "lexical", "rrf"):
        assert fusion.retriever(d, kind, 2)(q).where("rank = 1").first().doc_id == 0
    with pytest.raises(ValueError):
        fusion.retriever(d, "magic")
    hits, failed = fusion.retrieve_each(fusion.retriever(d, "lexical", 2), [q, q.select("item_id"), q])
    assert failed == [1] and {r.question_ord for r in hits.collect()} == {0, 2}


def test_embeddings_structures_and_caches(spark):
    adaptive.register_embedding("test:size", lambda: lambda texts: [[float(len(t))] for t in texts])
    assert [list(r.embedding) for r in adaptive.embed(docs(spark, "ab", None), "test:size").orderBy("doc_id").collect()] == [[2.0], [0.0]]
    with pytest.raises(ValueError):
        adaptive.register_embedding("plain", lambda: None)
    with pytest.raises(KeyError):
        adaptive.embed(docs(spark, "x"), "test:none")
    a = spark.createDataFrame([('{"subquestions": ["a", "b"]}',), ("no json",)], "answer string")
    assert [r.answer.subquestions if r.answer else None for r in adaptive.structured(a, "expansion").collect()] == [["a", "b"], None]
    p = spark.createDataFrame([(0, "old"), (1, "new")], "item_id long, prompt string")
    cache = p.where("item_id = 0").select(F.md5("prompt").alias("key"), F.lit("kept").alias("answer"))
    got, more = adaptive.cached_ask(p, cache, lambda: lambda prompts: [x.upper() for x in prompts])
    assert {r.item_id: r.answer for r in got.collect()} == {0: "kept", 1: "NEW"} and more.count() == 1
    assert adaptive.with_fallback(lambda: 1 / 0, lambda: p) is p


def test_depth_first_crawl_is_the_recursive_one(spark):
    import random

    def plain(links, start, prefix, depth, cap):
        seen, out = set(), []

        def visit(u, d):
            if len(out) == cap or u in seen:
                return
            seen.add(u)
            out.append((u, d))
            for v in sorted(links.get(u, ())) if d < depth else ():
                if v.startswith("http://h") and v.startswith(prefix or ""):
                    visit(v, d + 1)

        visit(start, 0)
        return out

    rng = random.Random(4)
    for n, degree, cap, prefix in ((6, 2, 200, None), (12, 2, 7, None), (25, 3, 200, None), (40, 2, 11, "http://h/1"), (9, 4, 3, None)):
        url = lambda i: f"http://h/{i}"
        pairs = [(url(rng.randrange(n)), url(rng.randrange(n))) for _ in range(n * degree)] * 2 + [(url(0), "http://other/1"), (url(0), url(0)), (url(1), None)]
        links = {}
        for a, b in pairs:
            if b:
                links.setdefault(a, set()).add(b)
        got = ingest.crawl_depth_first(spark.createDataFrame(pairs, "src_url string, dst_url string"), url(0), prefix, 4, cap).orderBy("place").collect()
        assert [(r.url, r.depth) for r in got] == plain(links, url(0), prefix, 4, cap)


def test_chunkers_in_sql_carry_the_other_columns(spark):
    table_functions.register(spark)
    rows = [(1, "a b c " * 60, "x", [1, 2]), (2, None, None, None), (3, "  ", "y", []), (4, "short", None, None)]
    spark.createDataFrame(rows, "doc_id int, text string, `of.what` string, n array<int>").createOrReplaceTempView("some_docs")
    got = spark.sql("SELECT * FROM split_recursive(TABLE(some_docs), 100, 10)")
    assert got.columns == ["doc_id", "of.what", "n", "chunk_index", "chunk"] and dict(got.dtypes)["n"] == "array<int>"
    want = [(d, w, n, i, c) for d, t, w, n in rows if t and t.strip() for i, c in enumerate(chunk.split_recursive(t, 100, 10))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert [tuple(r) for r in spark.sql("SELECT doc_id, chunk FROM split_long(TABLE(some_docs), 200) WHERE doc_id = 1 ORDER BY chunk_index").collect()] == [(1, c) for c in chunk.split_long(rows[0][1], 200)]
    for bad in ("split_recursive(TABLE(some_docs), 0, 1)", "split_long(TABLE(some_docs))", "split_long(TABLE(SELECT 1 AS a), 5)", "split_long(TABLE(SELECT 'x' AS text, 1 AS chunk), 5)"):
        with pytest.raises(Exception):
            spark.sql(f"SELECT * FROM {bad}").collect()


def test_semantic_breaks_are_those_of_a_plain_loop(spark):
    import hashlib
    import math
    import random

    import numpy as np

    def plain(text, least):
        s = [x.strip(" ") for x in __import__("re").split(r"[。！？.\n]", text)]
        s = [x for x in s if x]
        v = []
        for x in s:
            c = [0] * 64
            for w in x.split(" "):
                c[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
            v.append(c)
        norm = [math.sqrt(sum(a * a for a in c)) for c in v]
        d = [round(1 - sum(a * b for a, b in zip(v[i], v[i + 1])) / (norm[i] * norm[i + 1]), 9) for i in range(len(s) - 1)]
        limit = np.percentile(d, 95) if d else 0
        parts = [[]]
        for i, x in enumerate(s):
            parts[-1].append(x)
            if i < len(d) and d[i] > limit:
                parts.append([])
        parts = [" ".join(p) for p in parts if p]
        out, held = [], []
        for p in parts:
            held.append(p)
            if len(p) >= least:
                out.append(" ".join(held))
                held = []
        return out + [" ".join(held)] if held else out

    rng = random.Random(12)
    texts = [". ".join(" ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))) for _ in range(n)) for n in (1, 2, 3, 20, 41, 200)] + ["...", "one  two. three"]
    for least in (0, 12):
        assert chunks(chunk.semantic(docs(spark, *texts), min_chunk_size=least)) == [(i, c) for i, t in enumerate(texts) for c in plain(t, least)]


def test_semantic_chunks_shuffle_nothing_and_round_as_spark_does(spark):
    assert "Exchange" not in chunk.semantic(docs(spark, "a b. c d"))._jdf.queryExecution().executedPlan().toString()
    rng = __import__("random").Random(3)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 70))) + "." + " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 70))) for _ in range(300)]
    texts += [" ".join(["a"] * 31 + ["b"]) + "." + " ".join(["a"])]
    raw = [(float(x),) for k in range(1, 1025, 2) for x in (k / 1024, 1 - k / 1024)]
    got = [r[0] for r in spark.createDataFrame(raw, "x double").select(F.round("x", 9)).collect()]
    assert got == [float(chunk.Decimal(repr(x)).quantize(chunk._NINE, chunk.ROUND_HALF_UP)) for x, in raw]
    far = [chunk.sentence_distances(t.split(".")) for t in texts]
    p = [r[0] for r in spark.createDataFrame([(i, x) for i, f in enumerate([far[:30], far[30:]]) for v in f for x in v], "i int, x double").groupBy("i").agg(F.percentile("x", F.lit(0.95)).alias("p")).orderBy("i").select("p").collect()]
    assert p == [chunk._percentile([x for v in f for x in v], 0.95) for f in (far[:30], far[30:])]


def test_hybrid_search_shuffles_no_rows_of_pairs(spark):
    d, b = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "benchmark"))
    for search in (lexical.bm25, vector.hash_search):
        plan = search(d, b, 3)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
    assert sorted(lexical.bm25(d, b, 3, block=7).collect()) == sorted(lexical.bm25(d, b, 3).collect())
    assert lexical.bm25(d, b.where("false"), 3).count() == 0 and lexical.bm25(d.where("false"), b, 3).count() == 0

"""Pages to chunks: crawling over link tables, block pruning, and writing chunk collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import html_text
from lodestone.session import materialise


def links(pages: DataFrame) -> DataFrame:
    """(src_url, dst_url) of every <a href>, relative ones resolved against the page's host."""
    host = F.regexp_extract("url", r"^([a-z]+://[^/]+)", 1)
    href = F.explode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1)))
    out = pages.select(F.col("url").alias("src_url"), host.alias("host"), href.alias("href"))
    return out.select("src_url", F.when(F.col("href").startswith("/"), F.concat("host", "href")).otherwise(F.col("href")).alias("dst_url"))


def crawl_frontier(edges: DataFrame, start: str, prefix: str | None = None, depth: int = 4, cap: int = 200, depth_first: bool = False) -> DataFrame:
    """(url, depth): pages reached from `start` on its own host, within `depth` and the prefix, at most `cap`.

    Order is by depth and url (breadth first); depth_first takes a branch at a time, see crawl_depth_first().  A null prefix filters nothing.
    """
    if depth_first:
        return crawl_depth_first(edges, start, prefix, depth, cap).select("url", "depth")
    host = F.regexp_extract(F.lit(start), r"^([a-z]+://[^/]+)", 1)
    inside = edges.where(F.startswith("dst_url", host)).where(F.startswith("dst_url", F.lit(prefix)) if prefix else F.lit(True))
    found = edges.sparkSession.createDataFrame([(start, 0)], "url string, depth int")
    for d in range(1, depth + 1):
        frontier = found.where(F.col("depth") == d - 1).select(F.col("url").alias("src_url"))
        step = inside.join(frontier, "src_url", "left_semi").select(F.col("dst_url").alias("url")).distinct()
        found = found.unionByName(materialise(step.join(found.select("url"), "url", "left_anti").withColumn("depth", F.lit(d)), "level"))
    return found.orderBy("depth", "url").limit(cap)


def crawl_depth_first(edges: DataFrame, start: str, prefix: str | None = None, depth: int = 4, cap: int = 200) -> DataFrame:
    """(url, depth, place) of the first `cap` pages that a depth-first crawl visits, links in the order of their urls.

    A page's label is the path of urls by which it is first visited; labels in order are the order of visits, and a page's label is the
    least extension, by its own url, of the label of a page that links to it and isn't at the last depth.  Each step makes all labels
    anew from those of the step before, until none changes: a page that turns out to be first visited at the last
    depth then no longer passes anything on, as in a crawl that never visits a page again.
    """
    host = F.regexp_extract(F.lit(start), r"^([a-z]+://[^/]+)", 1)
    inside = edges.where(F.startswith("dst_url", host) & (F.startswith("dst_url", F.lit(prefix)) if prefix else F.lit(True)))
    inside = materialise(inside.where(F.col("dst_url") != start).select("src_url", "dst_url").distinct(), "links")
    root = edges.sparkSession.range(1).select(F.lit(start).alias("url"), F.array(F.lit(start)).alias("label"))
    labels, before = root, None
    while True:
        open_ = labels.where(F.size("label") <= depth).withColumnRenamed("url", "src_url")
        step = inside.join(open_, "src_url").groupBy(F.col("dst_url").alias("url")).agg(F.min(F.concat("label", F.array("dst_url"))).alias("label"))
        labels = materialise(step.unionByName(root), "labels")
        sums = labels.agg(F.count("*"), F.sum(F.xxhash64("url", "label").cast("decimal(38,0)"))).first()
        if sums == before:
            break
        before = sums
    first = labels.orderBy("label").limit(cap)
    return first.select("url", (F.size("label") - 1).alias("depth"), F.row_number().over(Window.orderBy("label")).alias("place"))


def blocks(pages: DataFrame) -> DataFrame:
    """(page_id, pos, block, html_chars, text_chars): pages cut at closing block tags."""
    parts = F.split("html", r"(?i)</(?:p|div|li|h[1-6]|td|article|section|footer|nav|ul|script|style)>")
    b = pages.select("page_id", F.posexplode(parts).alias("pos", "raw")).withColumn("block", html_text("raw"))
    return b.select("page_id", "pos", "block", "raw", F.length("raw").alias("html_chars"), F.length("block").alias("text_chars"))


def prune_blocks(pages: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Blocks of which at least `threshold` of the characters are text."""
    return blocks(pages).where("text_chars > 0").where(F.col("text_chars") >= threshold * F.col("html_chars")).drop("raw")


def write_collection(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Append (or overwrite) chunks in a Parquet collection partitioned by collection_id."""
    chunks.write.mode(mode).partitionBy("collection_id").parquet(path)


def read_collection(spark, path: str, collection_id: str) -> DataFrame:
    """One tenant's chunks: the filter prunes all other partitions."""
    return spark.read.parquet(path).where(F.col("collection_id") == collection_id)


def delete_documents(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunks of documents that stay."""
    return chunks.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")


def number_chunks(chunks: DataFrame) -> DataFrame:
    """chunk_id, an idempotent key, and chunk_index from 0 within a document."""
    index = (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).alias("chunk_index")
    out = chunks.select("*", index)
    return out.withColumn("chunk_id", F.md5(F.concat_ws("-", "doc_id", "chunk_index")))


def core_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of core content: none that begin navigation, headers, footers, sidebars or forms, and no list of links."""
    return blocks(pages).where("text_chars > 0").where(~F.col("raw").rlike(r"(?i)<(nav|footer|aside|header|form)[ >]") & ~F.col("raw").rlike(r"(?i)^\s*<(li|a)[ >]"))


def load_collection(spark, path: str, collection_id: str) -> DataFrame:
    """One tenant's chunks, kept in executors' memory (and on their disks) from their first use on."""
    return read_collection(spark, path, collection_id).persist()


def _collection(spark, path: str, collection_id: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/collection_id={collection_id}")
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_collection(spark, path: str, collection_id: str) -> str:
    """Delete a tenant's partition: success, or warning where there is none."""
    place, files = _collection(spark, path, collection_id)
    if not files.exists(place):
        return "warning"
    files.delete(place, True)
    return "success"


def drop_workspace(spark, stores: dict[str, str], collection_id: str) -> dict[str, str]:
    """Drop a collection in every store (path by name); a store that fails is reported and the others still go."""
    out = {}
    for name, path in stores.items():
        try:
            out[name] = drop_collection(spark, path, collection_id)
        except Exception as e:  # foreign storage: its failure is a result here
            out[name] = f"error: {type(e).__name__}"
    return out


def store(docs: DataFrame, path: str, collection_id: str, config, limit: int = 6000) -> dict:
    """Documents end to end: chunks by strategy, long ones split, numbered and appended to a collection; returns the totals."""
    from lodestone.operators import chunk as C

    chunks = C.chunk(docs, config).withColumnRenamed("chunk_index", "part")
    key = F.struct("doc_id", "part")
    parts = C.long_split(chunks.select(F.xxhash64(key).alias("doc_id"), F.col("chunk").alias("text")), limit).withColumnRenamed("doc_id", "key")
    split = chunks.select("doc_id", "part", F.xxhash64(key).alias("key")).join(parts, "key").select("doc_id", F.struct("part", "chunk_index").alias("pos"), "chunk")
    numbered = number_chunks(split).drop("pos").withColumn("collection_id", F.lit(collection_id))
    write_collection(numbered, path)
    stored = read_collection(docs.sparkSession, path, collection_id)
    row = stored.agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents")).first()
    return {"collection_id": collection_id, "chunks": row["chunks"], "documents": row["documents"], "strategy": config.strategy}

"""A kept inverted index: postings in blocks of neighbouring documents with the block's greatest BM25 part, and block-max skipping.

Documents are cut into ranges of `range_docs` neighbours.  A block holds a term's postings in one range, and its peak: the greatest part
(without idf) that the term adds to a document's score there.  Blocks lie in partitions by a hash of the term, sorted by
term and range.  A search adds up the peaks of each question's terms by range, which bounds the score of every document of the
range; scores the most promising ranges; and then reads only blocks of ranges whose bound reaches the k-th best score so far.
Texts are read when the index is built, never in a search.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.operators.lexical import K1, B, question_terms, top_k
from lodestone.session import materialise, small

_BLOCKS = "term string, range long, peak double, docs array<struct<doc_id:long,tf:long,dl:int>>, bucket int"


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")


def build(docs: DataFrame, path: str, buckets: int = 32, range_docs: int = 16) -> Postings:
    """Write the index of `docs` (doc_id, text; other columns are ignored) to `path` and open it.

    range_docs, a power of two, bounds a block.  Ranges are numbered within the partitions in which the documents are stored, after a
    sort by length there, without a shuffle.  A null or empty text counts as a document of no terms.  doc_id is taken as a key: rows that repeat one count
    as several documents.  A term in very many documents is split over tasks and files, since ranges are.
    """
    spark = docs.sparkSession
    step = range_docs.bit_length() - 1
    if 1 << step != range_docs:
        raise ValueError("range_docs must be a power of two")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(tokens("text"), F.array().cast("array<string>")).alias("ts"))
    # A range lies in one task, so its blocks are made there.  Documents of about the same length are neighbours, and near copies among them: their peaks are close to their own parts.
    sized = sized.withColumn("dl", F.size("ts"))
    total = sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    sized = sized.sortWithinPartitions("dl", "doc_id").withColumn("row", F.monotonically_increasing_id())
    blocks = sized.select("doc_id", "row", "dl", "ts").mapInArrow(_blocks(step, float(total["avgdl"] or 1)), "term string, range long, peak double, docs array<struct<doc_id:long,tf:long,dl:int>>")
    blocks = blocks.select("term", "range", "peak", "docs", _bucket(buckets))
    blocks.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "range").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    stored = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    terms = stored.groupBy("term", "bucket").agg(F.sum(F.size("docs")).alias("df"), F.count("*").alias("blocks"))
    terms.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    meta = {"n": total["n"], "avgdl": float(total["avgdl"] or 1), "buckets": buckets}
    spark.createDataFrame([(json.dumps(meta),)], "text string").coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")
    return open_postings(spark, path)


def _blocks(step: int, avgdl: float, rows: int = 1024):
    """Batches of (doc_id, row, dl, ts) by row -> the blocks of their ranges; a range that a batch breaks off waits for the next."""
    fields = [pa.field("doc_id", pa.int64()), pa.field("tf", pa.int64()), pa.field("dl", pa.int32())]

    def made(t: pa.Table) -> pa.RecordBatch:
        ts = t["ts"].combine_chunks()
        sizes = pc.list_value_length(ts).to_numpy()
        words = ts.flatten().dictionary_encode()
        wide = max(len(words.dictionary), 1)
        key, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * wide + words.indices.to_numpy(), return_counts=True)
        row, code = key // wide, key % wide
        ids = t["doc_id"].combine_chunks()
        place = np.argsort(pc.array_sort_indices(ids, null_placement="at_start").to_numpy(), kind="stable")
        of, dl = t["row"].to_numpy() >> step, t["dl"].to_numpy()
        order = np.lexsort((place[row], code, of[row]))
        row, code, tf = row[order], code[order], tf[order]
        first = np.flatnonzero(np.r_[True, (np.diff(code) != 0) | (np.diff(of[row]) != 0)][: len(row)])
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / avgdl))
        held = pa.StructArray.from_arrays([ids.take(pa.array(row)), pa.array(tf, pa.int64()), pa.array(dl[row], pa.int32())], fields=fields)
        docs = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)], pa.int32()), held)
        peak = np.maximum.reduceat(part, first) if len(first) else part
        return pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code[first])), pa.array(of[row[first]], pa.int64()), pa.array(peak, pa.float64()), docs], ["term", "range", "peak", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                t = pa.Table.from_batches([batch.slice(at, rows)])
                waiting = t if waiting is None else pa.concat_tables([waiting, t])
                of = waiting["row"].to_numpy() >> step
                whole = int(np.searchsorted(of, of[-1]))
                if whole:
                    yield made(waiting.slice(0, whole))
                    waiting = waiting.slice(whole)
        if waiting is not None:
            yield made(waiting)

    return run


def open_postings(spark: SparkSession, path: str) -> Postings:
    """An index that build() has written."""
    return Postings(spark, path, **json.loads(spark.read.parquet(f"{path}/corpus").first()["text"]))


@dataclass(frozen=True)
class Postings:
    spark: SparkSession
    path: str
    n: int
    avgdl: float
    buckets: int

    def _read(self, kind: str, schema: str, only: list[int] | None) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{kind}")
        return rows if only is None else rows.where(F.col("bucket").isin(only))

    def postings(self) -> DataFrame:
        """(term, doc_id, tf) of the whole index."""
        return self._read("blocks", _BLOCKS, None).select("term", F.explode("docs").alias("d")).select("term", "d.doc_id", "d.tf")

    def _terms(self, questions: DataFrame) -> tuple[DataFrame, list[int]]:
        """(item_id, term, idf) of the questions' terms that the index has, and the partitions they are in."""
        asked = question_terms(questions).select("item_id", "term", _bucket(self.buckets))
        asked = materialise(asked, "terms")
        only = sorted(r.bucket for r in asked.select("bucket").distinct().collect())  # `buckets` numbers at most
        known = self._read("terms", "term string, df long, blocks long, bucket int", only)
        idf = F.log(1 + (self.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return materialise(known.join(small(asked.drop("bucket")), "term").select("item_id", "term", idf.alias("idf")), "idf"), only

    def _bounds(self, terms: DataFrame, only: list[int]) -> DataFrame:
        """(item_id, range, bound, blocks): what the documents of a range can score at most; no list of documents is read for it."""
        heads = self._read("blocks", _BLOCKS, only).select("term", "range", "peak").join(small(terms), "term")
        return materialise(heads.groupBy("item_id", "range").agg(F.sum(F.col("idf") * F.col("peak")).alias("bound"), F.count("*").alias("blocks")), "bounds")

    def _scores(self, ranges: DataFrame, terms: DataFrame, only: list[int]) -> DataFrame:
        """(item_id, doc_id, score), rounded, of the documents in the ranges (item_id, range)."""
        wanted = materialise(ranges.join(terms, "item_id"), "wanted")
        blocks = self._read("blocks", _BLOCKS, only).select("term", "range", "docs").join(small(wanted), ["term", "range"])
        hits = blocks.select("item_id", "idf", F.explode("docs").alias("d"))
        part = F.col("idf") * F.col("d.tf") * (K1 + 1) / (F.col("d.tf") + K1 * (1 - B + B * F.col("d.dl") / F.lit(self.avgdl)))
        return hits.groupBy("item_id", F.col("d.doc_id").alias("doc_id")).agg(F.round(F.sum(part), 6).alias("score"))

    def _plan(self, questions: DataFrame, k: int):
        """The scores of the first ranges of each question, and what is left to read."""
        terms, only = self._terms(questions)
        bounds = self._bounds(terms, only)
        best = Window.partitionBy("item_id").orderBy(F.desc("bound"), "range")
        first = materialise(bounds.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("item_id", "range"), "first")
        scored = materialise(self._scores(first, terms, only), "scores")
        reached = top_k(scored, "item_id", k, "doc_id").where(F.col("rank") == k).select("item_id", F.col("score").alias("reached"))
        # A score is rounded to 6 places, and so may be its bound's equal though a little above it.
        rest = bounds.join(small(reached), "item_id", "left").where(F.col("bound") >= F.coalesce("reached", F.lit(0.0)) - 2e-6)
        rest = rest.join(first, ["item_id", "range"], "left_anti")
        return terms, only, bounds, first, scored, rest

    def search(self, questions: DataFrame, k: int) -> DataFrame:
        """(item_id, doc_id, score, rank): the k best documents of each question (item_id, text), ties by doc_id, as bm25() gives."""
        terms, only, _, _, scored, rest = self._plan(questions, k)
        more = self._scores(rest.select("item_id", "range"), terms, only)
        return top_k(scored.unionByName(more), "item_id", k, "doc_id")

    def skipped(self, questions: DataFrame, k: int) -> DataFrame:
        """(item_id, blocks, skipped): the blocks of each question's terms, and how many of them search() doesn't read."""
        _, _, bounds, first, _, rest = self._plan(questions, k)
        read = first.unionByName(rest.select("item_id", "range")).withColumn("read", F.lit(True))
        marked = bounds.join(read, ["item_id", "range"], "left")
        return marked.groupBy("item_id").agg(F.sum("blocks").alias("blocks"), F.coalesce(F.sum(F.when(F.col("read").isNull(), F.col("blocks"))), F.lit(0)).alias("skipped"))

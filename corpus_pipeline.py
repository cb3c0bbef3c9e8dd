"""The corpus pipeline: five stages, each a function (spark, docs, sf_dir) of the documents that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.decontaminate import contaminated
from lodestone.llm.entry import tokenizer_path
from lodestone.llm.jaccard_join import jaccard_join
from lodestone.llm.line_dedup import WHOLE, dedup_lines
from lodestone.llm.packing import pack
from lodestone.llm.quality import RULE, quality_rules
from lodestone.llm.store import broadcast_if_small, columns, named, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    own = {c: f"__{c}" for c in docs.columns if c in RULE.names}  # columns of the rules' names, which would be replaced
    judged = quality_rules(docs.withColumnsRenamed(own), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("kept").select(*(named(own.get(c, c)).alias(c) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those that have lost lines and have only blank ones left go."""
    own = {c: f"__{c}" for c in docs.columns if c in ("n_lines", "n_removed")}
    left = dedup_lines(docs.withColumnsRenamed(own), **WHOLE)
    return left.where(r"n_removed = 0 or text rlike '\\S'").select(*_measured(docs, own))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group linked at a similarity of 0.8 over five words; one of repeated rows."""
    groups = jaccard_join(docs, k=5, percent=80).groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias("rows"))
    special = broadcast_if_small(table(groups.where("doc_id <> c or rows > 1").select("doc_id", (F.col("doc_id") != F.col("c")).alias("__gone"))))
    judged = docs.join(special, "doc_id", "left")
    once = judged.where("__gone is null").select(*columns(docs))
    return once.unionByName(judged.where("not __gone").select(*columns(docs)).dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds no copy of a benchmark item; ids play no part, so rows without one are judged too."""
    th = F.xxhash64("text")
    held = contaminated(docs.select(th.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    held = broadcast_if_small(table(held.select(F.col("doc_id").alias("__held")).distinct()))
    return docs.join(held, th == F.col("__held"), "left_anti").select(*columns(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of at most 4096 tokens."""
    return pack(docs, tokenizer_path(), 4096, 1)


def _measured(docs: DataFrame, own: dict[str, str]) -> list:
    """The columns of docs (some of which have names of their own meanwhile), n_chars (if there) being the text's length now."""
    return [F.length("text").cast(f.dataType).alias("n_chars") if f.name == "n_chars" else named(own.get(f.name, f.name)).alias(f.name) for f in docs.schema]


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", packing),
]

#: Shingle links, alignment and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = table(docs)
    return docs

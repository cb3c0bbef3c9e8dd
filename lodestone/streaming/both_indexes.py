"""Pages as they come into two stores, the chunk table and the entity graph, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import html_text
from lodestone.operators import ingest
from lodestone.operators.graph_store import GraphStore
from lodestone.sources.tables import Table
from lodestone.streaming.progress import drain

WRITER = "ingest"


def chunks(pages: DataFrame) -> DataFrame:
    """(page_id, chunk_id, chunk_index, block, text_chars) of the blocks of pages that hold mostly text."""
    kept = ingest.number_chunks(ingest.prune_blocks(pages).withColumnRenamed("page_id", "doc_id"))
    return kept.select(F.col("doc_id").alias("page_id"), "chunk_id", "chunk_index", "block", F.col("text_chars").cast("long").alias("text_chars"))


def create(spark, path: str) -> tuple[Table, GraphStore]:
    """An empty chunk table and an empty graph under `path`."""
    none = spark.createDataFrame([], "page_id long, chunk_id string, chunk_index int, block string, text_chars long")
    return Table.create(none, f"{path}/chunks", ["page_id"]), GraphStore.create(spark, f"{path}/graph")


def commit(pages: DataFrame, epoch: int, table: Table, store: GraphStore) -> None:
    """One micro-batch into both, under its epoch.

    Either write may be the last before a crash: Spark gives the epoch again on restart, and a store that has it already adds nothing.
    """
    table.append(chunks(pages), WRITER, epoch)
    docs = pages.select(F.col("page_id").alias("doc_id"), html_text("html").alias("text")).persist()
    store.insert(docs, epoch)
    docs.unpersist()


def committed(table: Table, store: GraphStore) -> int:
    """The last epoch that both stores have."""
    return min(table.epoch(WRITER), store.batch())


def read_chunks(table: Table, store: GraphStore) -> DataFrame:
    """The chunks of all epochs that both stores have."""
    return table.read(table.as_of_epoch(WRITER, committed(table, store)))


def run(stream: DataFrame, table: Table, store: GraphStore, checkpoint: str | None = None, commit=commit) -> None:
    """Take all pages that there are; after a failure, call it again with the same checkpoint."""
    drain(stream, lambda df, epoch: commit(df, epoch, table, store), "append", checkpoint)

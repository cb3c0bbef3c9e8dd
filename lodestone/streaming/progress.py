"""Progress streams: the event protocol, crawl status, windows, and the streaming jobs with the same meaning.

Functions on DataFrames take batch and streaming input alike; `stream_*` start jobs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.session import shared_folder

EVENT = "type string, session_id long, seq long"


def sse_encode(events: DataFrame) -> DataFrame:
    """Adds line: `data: <json>` and an empty line, for columns type, session_id and seq."""
    return events.withColumn("line", F.concat(F.lit("data: "), F.to_json(F.struct("type", "session_id", "seq")), F.lit("\n\n")))


def sse_parse(lines: DataFrame) -> DataFrame:
    """(type, session_id, seq) of the well-formed `data:` lines."""
    body = F.trim(F.regexp_replace(F.col("line"), r"^data:|\n+$", ""))
    parsed = lines.where(F.col("line").startswith("data:")).select(F.from_json(body, EVENT).alias("e"))
    return parsed.where("e.type is not null").select("e.*")


def crawl_status(events: DataFrame) -> DataFrame:
    """Per collection (user_id): pages counted, status (an error outranks completion), latest message, first and last time."""
    return events.groupBy(F.col("user_id").alias("collection_id")).agg(
        F.count_if(F.col("event_type") == "view").alias("count"),
        F.when(F.count_if(F.col("event_type") == "error") > 0, "error").when(F.count_if(F.col("event_type") == "purchase") > 0, "completed").otherwise("processing").alias("status"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("message"),
        F.min("ts").alias("start_time"),
        F.max("ts").alias("last_update"),
    )


def windowed(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """(window, event_type, n, total) over tumbling windows, or sliding ones."""
    return events.groupBy(F.window("ts", length, slide or length), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(session, user_id, n): a session ends when nothing comes for `gap`."""
    return events.groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(F.count("*").alias("n"))


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of event files, with ts as a timestamp that watermarks take."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def read_pages(spark: SparkSession, path: str, files_per_trigger: int | None = 1, bytes_per_trigger: int = 1 << 30) -> DataFrame:
    """A stream of crawled pages, some files at a time, or where these are None as many as hold so many bytes; pages without text are skipped."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    stream = stream.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else stream.option("maxBytesPerTrigger", bytes_per_trigger)
    stream = stream.parquet(f"{path}*")
    return stream.where("html is not null and trim(html) <> ''")


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    count, failed, done, last, last_id, message = state.get if state.exists else (0, False, False, None, -1, "")
    for batch in batches:
        count += int((batch["event_type"] == "view").sum())
        failed |= bool((batch["event_type"] == "error").any())
        done |= bool((batch["event_type"] == "purchase").any())
        newest = batch.sort_values(["ts", "event_id"]).iloc[-1]
        if last is None or (newest["ts"].value, int(newest["event_id"])) > (last, last_id):
            last, last_id, message = newest["ts"].value, int(newest["event_id"]), newest["event_type"]
    state.update((count, failed, done, last, last_id, message))
    yield pd.DataFrame({"collection_id": [key[0]], "count": [count], "status": ["error" if failed else "completed" if done else "processing"], "message": [message]})


def stream_crawl_status(events: DataFrame) -> DataFrame:
    """The crawl state machine over a stream: an updated row for each collection that a batch touches.

    The fold doesn't depend on the order of events, so late and reordered ones give the batch twin's result.
    """
    return events.groupBy("user_id").applyInPandasWithState(_fold, "collection_id long, count long, status string, message string", "count long, failed boolean, done boolean, last long, last_id long, message string", "update", GroupStateTimeout.NoTimeout)


def stream_dedup(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events once each, remembering ids for `delay` of event time."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def start(df: DataFrame, name: str, mode: str = "update", checkpoint: str | None = None) -> StreamingQuery:
    """Start a job into an in-memory table that takes all input there is."""
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()


def drain(df: DataFrame, sink: Callable[[DataFrame, int], None], mode: str = "update", checkpoint: str | None = None, once: bool = False) -> None:
    """Run a stream over all input there is into a foreachBatch sink, with its checkpoint in the shared folder (or one of its own).

    once: in one batch; state that expires with the clock would else ask for further batches for ever.
    """
    w = df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint or shared_folder(df.sparkSession, "checkpoint"))
    (w.trigger(once=True) if once else w.trigger(availableNow=True)).start().awaitTermination()


def upsert_status(spark: SparkSession, table_path: str, updates: DataFrame, epoch: int) -> None:
    """A foreachBatch sink: each epoch's rows to a folder of its own, so that a repeated epoch writes the same."""
    updates.write.mode("overwrite").parquet(f"{table_path}/epoch={epoch}")


def read_status(spark: SparkSession, table_path: str) -> DataFrame:
    """The latest row of each collection in a status table."""
    rows = spark.read.parquet(table_path)
    return rows.groupBy("collection_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("collection_id", "epoch")]), "epoch").alias("r")).select("collection_id", "r.*")

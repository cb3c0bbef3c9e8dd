"""Intermediate tables in the cluster's shared folder, so that lineage is cut without depending on any executor."""

from __future__ import annotations

import atexit
import contextlib
import itertools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_serial = itertools.count()
_run = uuid.uuid4().hex[:12]
_made: dict[str, SparkSession] = {}
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset (as in tests) a folder of our own; on a cluster that is an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lodestone-"))
    return f"file://{_own[0]}"


def table(df: DataFrame) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and return a DataFrame that reads it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{_run}/{next(_serial)}"
    df.write.parquet(path)
    _made[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def narrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most `rows` rows in this session, unless it has a bound of its own: rows are whole texts, and Spark's
    10,000 of them are tens of megabytes in the executor and its Python worker each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def named(name: str) -> Column:
    """The column of exactly that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    """All columns of `df`, by exact name."""
    return [named(c) for c in df.columns]


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows (of a few numbers each), else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


@atexit.register
def cleanup() -> None:
    """Delete the tables that this process has written."""
    for path, spark in list(_made.items()):
        with contextlib.suppress(Exception):
            jvm = spark.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _made.clear()

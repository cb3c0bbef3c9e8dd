"""Session settings and the table loader."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a side that is still broadcast by hint; larger ones are left to the optimizer.
BROADCAST_ROWS = 200_000
_made: dict[str, SparkSession] = {}
_kept: dict[tuple, str] = {}


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution."""
    b = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.ui.enabled", "false")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; timestamps without a zone become UTC timestamps, which watermarks and time zone functions need."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*(F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name) for f in df.schema))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_size(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """`df` stored, with a broadcast hint if it has at most `rows` rows, and whether it has."""
    df = materialise(df, "side")
    few = df.count() <= rows
    return (F.broadcast(df) if few else df), few


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset (as in tests), under a temporary one, and on a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{(root or f'file://{_own_folder()}').rstrip('/')}/lodestone-work-{uuid.uuid4().hex[:12]}"
    _made[path] = spark
    return f"{path}/{name}"


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="lodestone-work-")


@atexit.register
def cleanup() -> None:
    """Delete the folders that this process has made, if their session is still there."""
    for path, spark in list(_made.items()):
        with contextlib.suppress(Exception):
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _made.clear()
    _kept.clear()


def kept_folder(spark: SparkSession, key: tuple, build: Callable[[str], object]) -> str:
    """The folder that `build` has filled; it is called once for each key and application, so that later queries reuse its work."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _kept:
        path = shared_folder(spark, "kept")
        build(path)
        _kept[key] = path
    return _kept[key]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to a shared folder and read it from there, which cuts its lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Tables that change: Parquet folders under a numbered manifest, with append, merge, update and delete.

A table's rows are dealt by a hash of its key into buckets.  A write puts new files into a folder of its own and then names, in
the next manifest, the folders of each bucket; readers see a version's manifest or the one before, never a part.  Merge,
update and delete rewrite the buckets that they touch and leave all others as they are.  The manifest is put in place by a
rename that fails where the version exists, so of two writers from one version the second gets a Conflict and nothing changes
(on a local disk, which has no such rename, between processes this is a check before it).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was making."""


def quoted(name: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


class _Files:
    """The few operations on the store's names that tables need, by Spark's own file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(root).getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self._path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(folder)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return str(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Make the file whole or not at all; False if it is there."""
        target, draft = self._path(name), self._path(f"{name}.{uuid.uuid4().hex}.draft")
        stream = self.fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self.fs.exists(target) and self.fs.rename(draft, target):
            return True
        self.fs.delete(draft, False)
        return False

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


@dataclass(frozen=True)
class Table:
    spark: SparkSession
    path: str

    # Versions

    @staticmethod
    def create(rows: DataFrame, path: str, key: list[str], buckets: int = 16, writer: str | None = None, epoch: int = 0) -> Table:
        """Version 0 of a table with these rows, keyed by the columns `key`; Conflict if there is a table."""
        table = Table(rows.sparkSession, path.rstrip("/"))
        if table.versions():
            raise Conflict(f"there is a table at {path}")
        base = {"version": -1, "time": 0, "key": key, "buckets": buckets, "schema": json.loads(rows.schema.json()), "files": {}, "writers": {}}
        table._commit(base, "create", table._write(rows, base), writer, epoch)
        return table

    @property
    def _files(self) -> _Files:
        return _Files(self.spark, self.path)

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._files.names(f"{self.path}/versions") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of a version."""
        if version is None:
            known = self.versions()
            if not known:
                raise FileNotFoundError(f"no table at {self.path}")
            version = known[-1]
        return json.loads(self._files.read(f"{self.path}/versions/{version:012d}.json"))

    def history(self) -> list[dict]:
        """(version, time in milliseconds, operation) of all versions that are kept."""
        return [{k: m[k] for k in ("version", "time", "operation")} for m in map(self.manifest, self.versions())]

    def as_of(self, at: int) -> int:
        """The newest version committed at or before a time in milliseconds."""
        found = [h["version"] for h in self.history() if h["time"] <= at]
        if not found:
            raise ValueError(f"no version of {self.path} is as old as {at}")
        return found[-1]

    def as_of_epoch(self, writer: str, epoch: int) -> int:
        """The newest version in which `writer` has got no further than `epoch`."""
        found = [m["version"] for m in map(self.manifest, self.versions()) if m["writers"].get(writer, -1) <= epoch]
        if not found:
            raise ValueError(f"no version of {self.path} has {writer} at {epoch} or before")
        return found[-1]

    def epoch(self, writer: str) -> int:
        """The last epoch that `writer` has committed; -1 before its first."""
        return self.manifest()["writers"].get(writer, -1)

    # Rows

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of another one."""
        return self._read(self.manifest(version))

    def _read(self, m: dict, only: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(m["schema"])
        paths = [f"{self.path}/{folder}/{_BUCKET}={b}" for b, folders in m["files"].items() for folder in folders if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, m: dict) -> Column:
        return F.pmod(F.xxhash64(*map(quoted, m["key"])), F.lit(m["buckets"])).cast("int")

    def _fit(self, rows: DataFrame, m: dict) -> DataFrame:
        """The table's columns, in its types; columns that `rows` lacks are null, and further ones an error."""
        fields = T.StructType.fromJson(m["schema"]).fields
        if more := set(rows.columns) - {f.name for f in fields}:
            raise ValueError(f"the table has no columns {sorted(more)}")
        return rows.select(*((quoted(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))

    def _write(self, rows: DataFrame, m: dict) -> dict[str, list[str]]:
        """Put the rows into a folder of their own; it by bucket, for those that have rows."""
        folder = f"data/{uuid.uuid4().hex}"
        dealt = self._fit(rows, m).withColumn(_BUCKET, self._bucket(m)).hint("rebalance", _BUCKET)
        dealt.write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        return {n.split("=")[1]: [folder] for n in self._files.names(f"{self.path}/{folder}") if n.startswith(_BUCKET)}

    def _commit(self, base: dict, operation: str, files: dict[str, list[str]], writer: str | None = None, epoch: int = 0) -> int:
        writers = base["writers"] | ({writer: epoch} if writer else {})
        m = base | {"version": base["version"] + 1, "time": max(int(time.time() * 1000), base["time"] + 1), "operation": operation, "files": files, "writers": writers}
        if not self._files.put_new(f"{self.path}/versions/{m['version']:012d}.json", json.dumps(m)):
            raise Conflict(f"version {m['version']} of {self.path} is another writer's")
        return m["version"]

    # Writes; each returns the version that holds its result

    def append(self, rows: DataFrame, writer: str | None = None, epoch: int = 0, tries: int = 5) -> int:
        """Add rows.  An epoch that `writer` has committed already, or one before it, changes nothing; others' appends don't conflict."""
        base = self.manifest()
        if writer and base["writers"].get(writer, -1) >= epoch:
            return base["version"]
        new = self._write(rows, base)
        for left in range(tries, 0, -1):
            files = {b: base["files"].get(b, []) + new.get(b, []) for b in base["files"] | new}
            try:
                return self._commit(base, "append", files, writer, epoch)
            except Conflict:
                base = self.manifest()
                if left == 1 or writer and base["writers"].get(writer, -1) >= epoch:
                    raise
        raise AssertionError

    def overwrite(self, rows: DataFrame, writer: str | None = None, epoch: int = 0) -> int:
        base = self.manifest()
        if writer and base["writers"].get(writer, -1) >= epoch:
            return base["version"]
        return self._commit(base, "overwrite", self._write(rows, base), writer, epoch)

    def _rewrite(self, base: dict, operation: str, touched: list[int], change: Callable[[DataFrame], DataFrame], writer: str | None = None, epoch: int = 0) -> int:
        """The next version, in which the touched buckets hold what `change` makes of their rows."""
        if not touched and not writer:
            return base["version"]
        kept = {b: f for b, f in base["files"].items() if int(b) not in touched}
        new = self._write(change(self._read(base, touched)), base) if touched else {}
        return self._commit(base, operation, kept | new, writer, epoch)

    def merge(self, source: DataFrame, update: dict[str, str] | None = None, insert: bool = True, delete: str | None = None, writer: str | None = None, epoch: int = 0) -> int:
        """Match rows by the key: SQL expressions over `t` (the table's row) and `s` (the source's) say what becomes of a match.

        update: new values by column (None: all that the source has); delete: a condition under which a match goes instead; insert:
        whether source rows without a match are added, with the table's columns of the same names.  A key twice in the
        source is an error, since its outcome would depend on order; keys with a null match nothing.
        """
        base = self.manifest()
        if writer and base["writers"].get(writer, -1) >= epoch:
            return base["version"]
        key, names = base["key"], [f["name"] for f in base["schema"]["fields"]]
        keyed = source.where(F.concat_ws("", *(F.when(quoted(k).isNull(), "x") for k in key)) == "")
        if not keyed.groupBy(*map(quoted, key)).count().where("count > 1").isEmpty():
            raise ValueError("the source of a merge has a key more than once")
        touched = sorted(r[0] for r in source.select(self._bucket(base)).distinct().collect())  # `buckets` numbers at most
        if update is None:
            update = {n: f"s.`{n.replace('`', '``')}`" for n in source.columns if n in names and n not in key}

        def change(rows: DataFrame) -> DataFrame:
            at = lambda side, n: F.col(f"{side}.`{n.replace('`', '``')}`")
            t, s = rows.withColumn("__t", F.lit(True)).alias("t"), source.withColumn("__s", F.lit(True)).alias("s")
            on = F.lit(True)
            for k in key:
                on = on & (at("t", k) == at("s", k))
            both = t.join(s, on, "full" if insert else "left")
            hit, old = F.col("__t").isNotNull() & F.col("__s").isNotNull(), F.col("__t").isNotNull()
            if delete is not None:
                both = both.where(~hit | ~F.coalesce(F.expr(delete), F.lit(False)))
            value = lambda n: F.when(hit, F.expr(update[n]) if n in update else at("t", n)).when(old, at("t", n)).otherwise(at("s", n) if n in source.columns else F.lit(None))
            return both.select(*(value(n).alias(n) for n in names))

        return self._rewrite(base, "merge", touched, change, writer, epoch)

    def _touched(self, base: dict, condition: str) -> list[int]:
        return sorted(r[0] for r in self._read(base).where(condition).select(self._bucket(base)).distinct().collect())

    def update(self, condition: str, values: dict[str, str]) -> int:
        """Set columns to SQL expressions where a condition holds."""
        base = self.manifest()

        def change(rows: DataFrame) -> DataFrame:
            return rows.select(*(F.when(F.expr(condition), F.expr(values[n])).otherwise(quoted(n)).alias(n) if n in values else quoted(n) for n in rows.columns))

        return self._rewrite(base, "update", self._touched(base, condition), change)

    def delete(self, condition: str) -> int:
        """Remove the rows for which a condition holds (not those for which it is null)."""
        base = self.manifest()
        return self._rewrite(base, "delete", self._touched(base, condition), lambda rows: rows.where(~F.coalesce(F.expr(condition), F.lit(False))))

    # Upkeep

    def compact(self) -> int:
        """Rewrite the buckets that lie in several folders, so that each lies in one."""
        base = self.manifest()
        return self._rewrite(base, "compact", [int(b) for b, folders in base["files"].items() if len(folders) > 1], lambda rows: rows)

    def vacuum(self, keep: int = 1) -> int:
        """Forget all but the last `keep` versions, and delete the folders that none of these names; the number of folders deleted.

        A write in progress has a folder that no version names yet, so no writer may be at work meanwhile.
        """
        known = self.versions()
        used = {f.split("/")[1] for v in known[-keep:] for folders in self.manifest(v)["files"].values() for f in folders}
        for v in known[:-keep]:
            self._files.delete(f"{self.path}/versions/{v:012d}.json")
        gone = [n for n in self._files.names(f"{self.path}/data") if n not in used]
        for n in gone:
            self._files.delete(f"{self.path}/data/{n}")
        return len(gone)

    def drop(self) -> None:
        self._files.delete(self.path)


class BoundedReader:
    """Reads that are at most `bound` milliseconds stale: a snapshot serves until it is older, then the newest takes its place."""

    def __init__(self, table: Table, bound: int, clock: Callable[[], int] = lambda: int(time.time() * 1000)):
        self.table, self.bound, self.clock, self.version, self.seen = table, bound, clock, None, 0

    def read(self) -> DataFrame:
        now = self.clock()
        if self.version is None or now - self.seen > self.bound:
            self.version, self.seen = self.table.versions()[-1], now
        return self.table.read(self.version)

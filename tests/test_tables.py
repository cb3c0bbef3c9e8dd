"""Tables that change: each operation against a plain dictionary, failures, conflicts, snapshots."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.sources.tables import BoundedReader, Conflict, Table

SCHEMA = "id long, name string, `a.b` int"


@pytest.fixture()
def made(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"n{i}", i % 3) for i in range(100)] + [(None, "none", 0)], SCHEMA)
    return Table.create(rows, str(tmp_path / "t"), ["id"], 8)


def rows(table, version=None):
    return sorted(map(tuple, table.read(version).collect()), key=str)


def test_any_sequence_of_writes_is_that_of_a_dictionary(spark, made):
    rng, want = random.Random(2), {i: (i, f"n{i}", i % 3) for i in range(100)} | {None: (None, "none", 0)}
    seen = {}
    for step in range(10):
        op = ["merge", "delete", "update", "append", "insert", "away"][step % 6]
        if op == "merge":
            some = {i: f"m{step}-{i}" for i in rng.sample(range(150), 20)}
            made.merge(spark.createDataFrame(list(some.items()), "id long, name string"))
            want |= {i: (i, n, want[i][2] if i in want else None) for i, n in some.items()}
        elif op == "delete":
            made.delete(f"id % 7 = {step % 7}")
            want = {k: v for k, v in want.items() if k is None or k % 7 != step % 7}
        elif op == "update":
            made.update("id < 20", {"a.b": "`a.b` + 10", "name": "upper(name)"})
            want = {k: (v[0], v[1].upper(), None if v[2] is None else v[2] + 10) if k is not None and k < 20 else v for k, v in want.items()}
        elif op == "append":
            made.append(spark.createDataFrame([(1000 + step, "new")], "id long, name string"))
            want[1000 + step] = (1000 + step, "new", None)
        elif op == "insert":
            made.merge(spark.createDataFrame([(5, "no"), (2000 + step, "yes")], "id long, name string"), update={})
            want |= {i: (i, n, None) for i, n in ((5, "no"), (2000 + step, "yes")) if i not in want}
        else:
            made.merge(spark.createDataFrame([(8, 1), (9, 0)], "id long, gone int").withColumnRenamed("gone", "a.b"), update={}, insert=False, delete="s.`a.b` = 1")
            want.pop(8, None)
        assert rows(made) == sorted(want.values(), key=str), op
        seen[made.versions()[-1]] = sorted(want.values(), key=str)
    for version, held in seen.items():  # every version is still what it was
        assert rows(made, version) == held
    made.compact()
    assert rows(made) == sorted(want.values(), key=str) and all(len(f) == 1 for f in made.manifest()["files"].values())
    assert made.vacuum(1) > 0 and rows(made) == sorted(want.values(), key=str) and len(made.versions()) == 1


def test_only_touched_buckets_are_rewritten(spark, made):
    before = made.manifest()["files"]
    made.merge(spark.createDataFrame([(7, "seven")], "id long, name string"))
    after = made.manifest()["files"]
    assert sum(after[b] != before[b] for b in before) == 1
    made.delete("id = -1")
    assert made.manifest()["files"] == after and len(made.versions()) == 2


def test_a_repeated_epoch_changes_nothing(spark, made):
    new = spark.createDataFrame([(500, "x")], "id long, name string")
    first = made.append(new, "job", 3)
    assert made.append(new, "job", 3) == made.append(new, "job", 2) == first and made.epoch("job") == 3 and made.epoch("other") == -1
    assert made.read().where("id = 500").count() == 1
    assert made.append(new, "job", 4) == first + 1 and made.merge(new, writer="job", epoch=4) == first + 1
    assert made.as_of_epoch("job", 3) == first and made.as_of_epoch("job", 0) == 0


def test_a_failed_write_leaves_the_old_version(spark, made):
    held = rows(made)
    bad = spark.range(50).select("id", F.when(F.col("id") == 41, F.raise_error(F.lit("lost"))).otherwise("x").cast("string").alias("name"))
    for write in (made.append, made.overwrite, made.merge):
        with pytest.raises(Exception, match="lost"):
            write(bad)
    assert rows(made) == held and made.versions() == [0]
    made.vacuum(1)
    assert rows(made) == held


def test_of_two_writers_one_gets_a_conflict(spark, made):
    base = made.manifest()
    made.append(spark.createDataFrame([(900, "first")], "id long, name string"))
    with pytest.raises(Conflict):
        made._commit(base, "delete", {})
    assert made.read().where("id = 900").count() == 1
    with pytest.raises(Conflict):
        Table.create(made.read(), made.path, ["id"])


def test_errors_are_told(spark, made, tmp_path):
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "id long, name string")
    with pytest.raises(ValueError):
        made.merge(twice)
    with pytest.raises(ValueError):
        made.append(twice.withColumn("more", F.lit(1)))
    with pytest.raises(FileNotFoundError):
        Table(spark, str(tmp_path / "nowhere")).read()
    made.merge(spark.createDataFrame([(None, "null key")], "id long, name string"))
    assert made.read().where("id is null").count() == 2  # it matches nothing
    made.drop()
    assert made.versions() == []


def test_an_empty_table_takes_writes(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    table = Table.create(none, str(tmp_path / "e"), ["id"])
    assert table.read().count() == 0 and table.read().schema == none.schema
    table.merge(none)
    table.delete("true")
    table.append(spark.createDataFrame([(1, "a", 2)], SCHEMA))
    assert rows(table) == [(1, "a", 2)]


def test_snapshots_by_time_and_bounded_staleness(spark, made):
    for i in (1, 2):
        made.append(spark.createDataFrame([(1000 + i, "late")], "id long, name string"))
    times = [h["time"] for h in made.history()]
    assert [made.as_of(t) for t in times] == [0, 1, 2] and made.as_of(times[1] + 10**9) == 2 and made.as_of(times[2] - 1) == 1
    with pytest.raises(ValueError):
        made.as_of(times[0] - 1)
    assert made.read(made.as_of(times[1])).count() == 102
    now = [0]
    reader = BoundedReader(made, 100, lambda: now[0])
    assert reader.read().count() == 103
    made.append(spark.createDataFrame([(2000, "later")], "id long, name string"))
    now[0] = 100
    assert reader.read().count() == 103  # 100 ms old: within the bound
    now[0] = 101
    assert reader.read().count() == 104
    assert BoundedReader(made, 0, lambda: now[0]).read().count() == 104

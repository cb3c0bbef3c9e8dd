"""The kept graph, streams into two stores, run state and the run protocol."""

import collections
import hashlib
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.operators.graph_store import GraphStore
from lodestone.streaming import both_indexes, runs

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "alpha " * 50), (-4, " ".join(f"wordy{i}" for i in range(300)))], "doc_id long, text string")
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd).cache()


def test_three_inserts_are_one_build(spark, docs, tmp_path):
    store = GraphStore.create(spark, str(tmp_path / "g"), buckets=3)
    assert store.batch() == -1 and store.entities().count() == 0 and store.edges().count() == 0
    for b in range(3):
        store.insert(docs.where(F.pmod("doc_id", F.lit(3)) == b), b)
        if b == 0:
            early = rows(store.entities())
    ents = graph.entities(docs)
    want = rows(ents), rows(graph.cooccurrence_edges(docs, ents))
    assert (rows(store.entities()), rows(store.edges())) == want and store.documents() == docs.count()
    assert early != want[0]  # bounds follow the corpus
    store.insert(docs, 2)  # a batch again
    assert (rows(store.entities()), rows(store.edges())) == want
    store.compact()
    assert (rows(store.entities()), rows(store.edges())) == want and store.batch() == 2 and store.documents() == docs.count()
    store.insert(docs.where("doc_id = 1"), 3)
    assert store.documents() == docs.count() + 1


def test_an_insert_that_broke_off_is_not_seen_until_it_is_whole(spark, docs, tmp_path, monkeypatch):
    store = GraphStore.create(spark, str(tmp_path / "g"), buckets=2)
    store.insert(docs.where("doc_id % 2 = 0"), 0)
    held = rows(store.entities()), rows(store.edges()), store.documents()
    whole = GraphStore._table

    class Broken:
        def append(self, *a):
            raise RuntimeError("executor lost")

    monkeypatch.setattr(GraphStore, "_table", lambda self, kind: Broken() if kind == "edges" else whole(self, kind))
    with pytest.raises(RuntimeError):
        store.insert(docs.where("doc_id % 2 <> 0"), 1)
    monkeypatch.undo()
    assert (rows(store.entities()), rows(store.edges()), store.documents()) == held
    store.compact()  # waits for the rest
    store.insert(docs.where("doc_id % 2 <> 0"), 1)
    ents = graph.entities(docs.where("doc_id % 2 is not null"))
    assert rows(store.entities()) == rows(ents)


def test_a_crash_between_two_stores_leaves_both_the_same(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pages.repartition(4).write.parquet(str(tmp_path / "pages"))
    stream = lambda: spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pages"))

    def contents(table, store):
        return rows(both_indexes.read_chunks(table, store).drop("chunk_id")), rows(store.entities()), rows(store.edges())

    whole = both_indexes.create(spark, str(tmp_path / "a"))
    both_indexes.run(stream(), *whole, str(tmp_path / "ca"))
    want = contents(*whole)
    assert both_indexes.committed(*whole) == 3 and len(want[0]) > 10

    table, store = both_indexes.create(spark, str(tmp_path / "b"))

    def crash(df, epoch, table, store):
        if epoch == 2:
            table.append(both_indexes.chunks(df), both_indexes.WRITER, epoch)
            raise RuntimeError("lost between the two")
        both_indexes.commit(df, epoch, table, store)

    with pytest.raises(Exception, match="lost between"):
        both_indexes.run(stream(), table, store, str(tmp_path / "cb"), crash)
    assert table.epoch(both_indexes.WRITER) == 2 and store.batch() == both_indexes.committed(table, store) == 1
    assert both_indexes.read_chunks(table, store).count() < table.read().count()
    both_indexes.run(stream(), table, store, str(tmp_path / "cb"))
    assert contents(table, store) == want


UPDATE = "thread_id long, seq long, field string, value string"


def plain_states(updates):
    by = collections.defaultdict(dict)
    for thread, seq, field, value in updates:
        if None not in (thread, seq, field):
            by[thread].setdefault(seq, (field, value))
    out = {}
    for thread, held in by.items():
        seqs, last = sorted(held), {}
        for s in seqs:
            last[held[s][0]] = held[s][1]
        history = [(s, p, held[s][0]) for s, p in zip(seqs, [None, *seqs])][-10:]
        out[thread] = (last, history[::-1])
    return out


def test_run_state_is_that_of_a_fold_and_survives_a_restart(spark, tmp_path):
    rng = random.Random(6)
    updates = [(rng.randrange(5), s, rng.choice(["need", "type", "answer"]), f"v{s}") for s in range(90)] + [(7, 1, "need", None), (None, 1, "x", "y"), (8, None, "x", "y")]
    rng.shuffle(updates)
    path, parts = str(tmp_path / "updates"), [updates[:40], updates[40:60] + updates[:5], updates[60:]]
    table = runs.create_states(spark, str(tmp_path / "states"))
    stream = lambda: spark.readStream.schema(UPDATE).option("maxFilesPerTrigger", 1).parquet(path)
    seen = []
    for part in parts:  # each run starts anew from the checkpoint
        spark.createDataFrame(part, UPDATE).coalesce(1).write.mode("append").parquet(path)
        runs.keep_states(stream(), table, str(tmp_path / "c"))
        seen += part
        want = plain_states(seen)
        assert {r.thread_id for r in table.read().collect()} == set(want)
        for thread, (state, history) in want.items():
            assert runs.get_state(table, thread) == state and runs.get_history(table, thread) == history
    assert runs.get_state(table, 99) is None and runs.get_history(table, 99) == []


def test_states_have_a_time_to_live(spark, tmp_path):
    path = str(tmp_path / "updates")
    table = runs.create_states(spark, str(tmp_path / "states"))
    for seq in (1, 2):
        spark.createDataFrame([(1, seq, f"f{seq}", "v")], UPDATE).coalesce(1).write.mode("append").parquet(path)
        runs.keep_states(spark.readStream.schema(UPDATE).parquet(path), table, str(tmp_path / "c"), ttl_ms=1)
    assert runs.get_state(table, 1) == {"f2": "v"}  # the first update was forgotten


def plain_protocol(events, timeout, now):
    out, by = [], collections.defaultdict(list)
    for session, at, event_id, kind in events:
        by[session].append((at, event_id, kind))
    for session, held in by.items():
        start = last = n = None
        for at, event_id, kind in sorted(e for e in held if e[0] < now):
            if start is not None and at - last > timeout:
                out.append((session, "timeout", start, last, None, n))
                start = None
            if kind == "start" and start is None:
                start, n = at, 1
            elif kind == "start" or start is None:
                out.append((session, "violation", None, at, event_id, None))
            else:
                n += 1
                if kind in ("complete", "error"):
                    out.append((session, kind, start, at, event_id, n))
                    start = None
            last = at
        if start is not None and now - last > timeout:
            out.append((session, "timeout", start, last, None, n))
    return sorted(out, key=str)


def test_protocol_on_legal_broken_unfinished_and_reordered_sequences(spark, tmp_path):
    legal = [(1, 0, "start"), (1, 10, "node_update"), (1, 20, "token"), (1, 30, "complete"), (2, 5, "start"), (2, 6, "error")]
    broken = [(3, 0, "token"), (3, 5, "start"), (3, 6, "start"), (3, 7, "complete"), (3, 8, "complete"), (4, 1, "error")]
    silent = [(5, 0, "start"), (5, 50, "token"), (5, 900, "token"), (6, 0, "start"), (7, 9990, "start"), (7, 9995, "token")]
    rng = random.Random(3)
    noise = [(10 + rng.randrange(6), rng.randrange(9000), rng.choice(["start", "node_update", "token", "complete", "error"])) for _ in range(300)]
    base = 1_000_000  # a stream's watermark begins at 0, and what isn't after it is late
    events = [(s, base + at, i, kind) for i, (s, at, kind) in enumerate(legal + broken + silent + noise + [(9, 10_000, "start")])]
    first = [e for e in events if e[1] < base + 5000]
    rest = [e for e in events if e[1] >= base + 5000]
    rng.shuffle(first)
    path, table = str(tmp_path / "events"), runs.create_runs(spark, str(tmp_path / "runs"))
    schema = "session_id long, ms long, event_id long, kind string"
    for part in (first, rest):
        more = part + [(1, part[0][1], 5000 + len(part), "unknown"), (None, part[0][1], 1, "start")]
        spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.timestamp_millis("ms"))
        runs.keep_runs(stream, table, "100 milliseconds", 200, str(tmp_path / "c"))
        done = first if part is first else events
        now = max(e[1] for e in done) - 100
        assert rows(table.read()) == plain_protocol(done, 200, now)
    late = spark.createDataFrame([(20, base + 50, 9000, "start"), (20, base + 60, 9001, "complete")], schema)
    late.coalesce(1).write.mode("append").parquet(path)
    runs.keep_runs(spark.readStream.schema(schema).parquet(path).withColumn("ts", F.timestamp_millis("ms")), table, "100 milliseconds", 200, str(tmp_path / "c"))
    assert rows(table.read()) == plain_protocol(events, 200, base + 9900)  # dropped


class _Held:
    def __init__(self):
        self.rows, self.calls = [], 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows, self.calls = list(rows), self.calls + 1

    def appendList(self, rows):
        self.put(self.rows + rows)

    def clear(self):
        self.put([])


class _Handle:
    def __init__(self):
        self.lists, self.timers = {}, []

    def getListState(self, name, schema):
        return self.lists.setdefault(name, _Held())

    def registerTimer(self, at):
        self.timers.append(at)


def test_protocol_calls_its_state_by_group_not_by_event(spark):
    rng = random.Random(4)
    events = [(rng.randrange(50), rng.randrange(1, 10_000), i, rng.choice(["start", "node_update", "token", "complete", "error"])) for i in range(2000)]
    handle, one = _Handle(), runs._Protocol(200)
    one.init(handle)
    for part in (events[:1000], events[1000:]):
        list(one.handleInputRows((0,), iter([pd.DataFrame(part, columns=["session_id", "at_ms", "event_id", "kind"])]), None))
    got = []
    for now in (5000, 9000):
        assert min(handle.timers) < now
        times = type("Times", (), {"getCurrentWatermarkInMs": lambda self, now=now: now})()
        for frame in one.handleExpiredTimer((0,), times, None):
            got += [tuple(None if pd.isna(v) else v for v in r) for r in frame.itertuples(index=False)]
    assert sorted(got, key=str) == plain_protocol(events, 200, 9000)
    assert len(handle.timers) <= 6 and sum(x.calls for x in handle.lists.values()) <= 6


def test_pages_in_many_files_are_few_batches(spark, tmp_path):
    from lodestone import kept_queries
    from lodestone.streaming import progress

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pages.repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    table, store = both_indexes.create(spark, f"{tmp_path}/both")
    both_indexes.run(progress.read_pages(spark, f"{tmp_path}/pages.parquet", None), table, store)
    assert both_indexes.committed(table, store) == 0
    assert rows(kept_queries.st_ingest_both(spark, str(tmp_path))) == rows(kept_queries.st_ingest_both(spark, SF))


def test_a_relation_is_reached_by_words_of_its_sentences(spark):
    texts = ["alpha knows bravo from the harbour concert", "alpha met bravo at the harbour concert", "delta paid gamma for old bricks", "delta owes gamma for old bricks", "nothing else here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    edges = spark.createDataFrame([("alpha", "bravo", 2), ("delta", "gamma", 2)], "src string, dst string, weight long")
    profiles = graph.relation_profiles(docs, edges)
    assert [(r.src, r.dst, len(r.profile)) for r in profiles.orderBy("src").collect()] == [("alpha", "bravo", 64), ("delta", "gamma", 64)]
    asked = spark.createDataFrame([(1, "harbour concert"), (2, "bricks old")], "item_id long, text string")
    got = graph.relation_chunks(docs, profiles, asked, 2, top_edges=1).orderBy("item_id", "rank").collect()
    assert [(r.item_id, r.doc_id) for r in got] == [(1, 0), (1, 1), (2, 2), (2, 3)]
    assert graph.relation_chunks(docs, profiles.limit(0), asked, 2).count() == 0


def test_the_graph_keeps_sentences_and_makes_only_the_pairs_asked_for(spark, docs, tmp_path):
    store = GraphStore.create(spark, str(tmp_path / "g"), buckets=2)
    store.insert(docs, 0)
    kept = store._table("edges").read()
    assert kept.where("size(terms) = 300 and n = 1").count() == 1  # one row, not 44,850 pairs
    asked = spark.createDataFrame([("wordy1",), ("wordy2",), ("nowhere",), *[(r.src,) for r in store.edges().limit(3).collect()]], "term string")
    terms = {r.term for r in asked.collect()}
    want = sorted(tuple(r) for r in store.edges().collect() if {r.src, r.dst} & terms)
    assert want and sorted(map(tuple, store.edges_of(asked).collect())) == want


def test_relation_sums_are_made_where_the_pairs_are(spark):
    texts = ["alpha knows bravo and bravo. delta met alpha", "alpha knows bravo and bravo. alpha gamma", "gamma saw alpha with bravo", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    edges = spark.createDataFrame([("alpha", "bravo", 3), ("alpha", "never", 2)], "src string, dst string, weight long")
    plan = graph.relation_profiles(docs, edges)._jdf.queryExecution().toString()
    assert not re.search(r"hashpartitioning\(src#\d+, dst#\d+", plan)  # pairs aren't shuffled
    (row,) = graph.relation_counts(docs, edges).collect()
    words = "alpha knows bravo and bravo alpha knows bravo and bravo gamma saw alpha with bravo".split()
    want = [0] * 64
    for w in words:
        want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
    assert (row.src, row.dst, row.counts) == ("alpha", "bravo", want) and row.norm == sum(x * x for x in want) ** 0.5


def test_relation_search_ranks_edges_where_they_are_made(spark, docs, tmp_path, monkeypatch):
    same = " ".join(f"twice{i}" for i in range(60))  # 1,770 edges of one score
    d = docs.unionByName(spark.createDataFrame([(i, f"{same}. another {same[:69]} once") for i in range(-9, -5)], "doc_id long, text string")).cache()
    asked = d.where("doc_id in (-9, 1, 2, 3)").select(F.expr("doc_id % 4").cast("long").alias("item_id"), "text")
    edges = graph.cooccurrence_edges(d, graph.entities(d))
    want = rows(graph.relation_chunks(d, graph.relation_profiles(d, edges), asked, 5))
    stored, keep = {}, graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: stored.update({name: keep(df, name)}) or stored[name])
    graph.keep_relations(d, str(tmp_path / "r"))
    assert {r[0] for r in want} == {-1, 1, 2, 3} and rows(graph.relation_search(d, str(tmp_path / "r"), asked, 5)) == want
    assert 80 <= stored["near"].count() < edges.count() / 2  # not a row for each edge
    assert rows(graph.relation_search(d, str(tmp_path / "r"), asked.limit(0), 5)) == []
    assert rows(graph.relation_search(d, str(tmp_path / "r"), asked, 5, block=2)) == want

"""Run state by thread, and the run protocol, over streams: state that Spark keeps, checkpoints and expires.

The state of a thread is the last value of each field and the last ten updates; the protocol is an ordered state machine with event-time
timers.  Neither depends on how events fall into micro-batches, so both have a twin in SQL.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from lodestone.sources.tables import Table
from lodestone.streaming.progress import drain

HISTORY = 10
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
STATE = "thread_id long, last_seq long, state array<struct<field:string,value:string>>, history array<struct<seq:long,parent:long,field:string>>"
#: Groups of sessions that the protocol's state is kept by.
GROUPS = 1024
RUN = "session_id long, what string, start_ms long, at_ms long, event_id long, events long"


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, which processors with state of their own need."""
    key, ours = _PROVIDER
    before = spark.conf.get(key, None)
    spark.conf.set(key, ours)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class _Threads(StatefulProcessor):
    """Per thread: a map of fields to their last update, and a list of the last HISTORY updates and the one before them."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.fields = handle.getMapState("fields", "field string", "seq long, value string", self.ttl_ms)
        self.updates = handle.getListState("updates", "seq long, field string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        updates = {seq: field for seq, field in self.updates.get()} if self.updates.exists() else {}
        for batch in rows:
            for seq, field, value in zip(batch["seq"].tolist(), batch["field"].tolist(), batch["value"].tolist()):
                held = self.fields.getValue((field,)) if self.fields.containsKey((field,)) else None
                if held is None or seq > held[0]:
                    self.fields.updateValue((field,), (seq, value))
                updates.setdefault(seq, field)
        last = sorted(updates.items())[-(HISTORY + 1) :]
        self.updates.put(last)
        state = [{"field": f, "value": held[1]} for (f,), held in sorted(self.fields.iterator())]
        parents = [None, *(s for s, _ in last)]
        history = [{"seq": s, "parent": p, "field": f} for (s, f), p in zip(last, parents)][-HISTORY:]
        yield pd.DataFrame({"thread_id": [key[0]], "last_seq": [last[-1][0]], "state": [state], "history": [history]})

    def close(self) -> None:
        pass


def thread_states(updates: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of updates (thread_id, seq, field, value) -> after each batch, the state of the threads that it touched.

    seq orders a thread's updates, in whatever order they come; an update that comes again changes nothing.  `state` has the last
    value of each field, by field; `history` the last ten updates with the one each followed.  A thread that isn't touched for
    ttl_ms milliseconds is forgotten.  Rows without a thread, seq or field are left out.
    """
    rows = updates.where("thread_id is not null and seq is not null and field is not null").select(F.col("thread_id").cast("long").alias("thread_id"), F.col("seq").cast("long").alias("seq"), "field", "value")
    return rows.groupBy("thread_id").transformWithStateInPandas(_Threads(ttl_ms), STATE, "Update", "None" if ttl_ms is None else "ProcessingTime")


def create_states(spark: SparkSession, path: str) -> Table:
    return Table.create(spark.createDataFrame([], STATE), path, ["thread_id"])


def keep_states(updates: DataFrame, table: Table, checkpoint: str | None = None, ttl_ms: int | None = None) -> None:
    """Take all updates there are into the table of states; called again with the checkpoint, it goes on where it was."""
    with state_store(updates.sparkSession):
        drain(thread_states(updates, ttl_ms), lambda df, epoch: table.merge(df.persist(), writer="states", epoch=epoch), "update", checkpoint, once=ttl_ms is not None)


def get_state(table: Table, thread_id: int) -> dict[str, str] | None:
    """The last value of each field of a thread; None if there is no such thread."""
    row = table.read().where(F.col("thread_id") == thread_id).select("state").first()
    return {f: v for f, v in row.state} if row else None


def get_history(table: Table, thread_id: int) -> list[tuple]:
    """(seq, parent, field) of a thread's last ten updates, the latest first."""
    row = table.read().where(F.col("thread_id") == thread_id).select("history").first()
    return [tuple(h) for h in reversed(row.history)] if row else []


class _Protocol(StatefulProcessor):
    """Events wait until the watermark has passed them, and are then taken in order of time and id.

    A key is a group of sessions, so that reading and writing state, and timers, cost a call for each group and not for each event or
    session.  A timer stands at the first event that waits, and one at the first timeout of an open run; either takes all that is due.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "session long, at long, id long, kind string")
        self.open = handle.getListState("open", "session long, start long, last long, events long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [event for batch in rows for event in zip(*(batch[c].tolist() for c in ("session_id", "at_ms", "event_id", "kind")))]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(event[1] for event in new))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        before = {session: tuple(run) for session, *run in self.open.get()} if self.open.exists() else {}
        later, due = [e for e in waiting if e[1] >= now], sorted(e for e in waiting if e[1] < now)
        runs, out = dict(before), []
        for session, at, event_id, kind in due:
            start, last, events = runs.pop(session, (None, None, None))
            if start is not None and at - last > self.timeout_ms:
                out.append((session, "timeout", start, last, None, events))
                start = None
            if kind == "start" and start is None:
                runs[session] = at, at, 1
            elif kind == "start" or start is None:
                out.append((session, "violation", None, at, event_id, None))
                if start is not None:
                    runs[session] = start, at, events
            elif kind in ("complete", "error"):
                out.append((session, kind, start, at, event_id, events + 1))
            else:
                runs[session] = start, at, events + 1
        for session, (start, last, events) in list(runs.items()):
            if now - last > self.timeout_ms:
                out.append((session, "timeout", start, last, None, events))
                del runs[session]
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
            if later:
                self.handle.registerTimer(min(event[1] for event in later))
        if runs != before:
            self.open.put([(session, *run) for session, run in runs.items()]) if runs else self.open.clear()
        if runs:
            self.handle.registerTimer(min(last for _, last, _ in runs.values()) + self.timeout_ms)
        if out:
            yield pd.DataFrame(out, columns=["session_id", "what", "start_ms", "at_ms", "event_id", "events"]).astype({c: "Int64" for c in ("start_ms", "at_ms", "event_id", "events")})

    def close(self) -> None:
        pass


def protocol(events: DataFrame, delay: str, timeout_ms: int) -> DataFrame:
    """A stream of events (session_id, ts, event_id, kind) -> the runs that have ended, and the events that break the protocol.

    A run goes start, then node_update and token in any number, then complete or error.  `what` is complete, error, timeout (nothing
    came in its session for more than timeout_ms) or violation: a start within a run, or anything else outside one.  A run has its first
    and last time and its number of events; a violation its own time and id.  Events may be `delay` late; later ones are
    dropped.  Rows without a session, time or id are left out, and so are kinds that the protocol doesn't have.
    """
    known = events.where(F.col("kind").isin("start", "node_update", "token", "complete", "error") & F.col("session_id").isNotNull() & F.col("ts").isNotNull() & F.col("event_id").isNotNull())
    rows = known.withWatermark("ts", delay).select(F.col("session_id").cast("long").alias("session_id"), "ts", F.col("event_id").cast("long").alias("event_id"), "kind", F.unix_millis("ts").alias("at_ms"))
    return rows.withColumn("sessions", F.pmod(F.xxhash64("session_id"), F.lit(GROUPS))).groupBy("sessions").transformWithStateInPandas(_Protocol(timeout_ms), RUN, "Append", "EventTime")


def create_runs(spark: SparkSession, path: str) -> Table:
    return Table.create(spark.createDataFrame([], RUN), path, ["session_id"])


def keep_runs(events: DataFrame, table: Table, delay: str, timeout_ms: int, checkpoint: str | None = None) -> None:
    """Take all events there are into the table of ended runs and violations, each once."""
    with state_store(events.sparkSession):
        drain(protocol(events, delay, timeout_ms), lambda df, epoch: table.append(df.persist(), "runs", epoch), "append", checkpoint)

"""The states of an upload as a stateful stream: each event moves a document on, or is refused, or comes for nothing.

A document goes through STATES one by one; from any but the last it may fail, and it may be deleted at any time. What
makes no such step is refused, as is an event that is older than the one before it. A document that stays in one state
for too long fails by a timer of event time, and another timer forgets it some time after it has ended, so that state
doesn't grow for ever. Events of documents that nobody knows, or knows no more, come for nothing.

One rule, `step`, is behind the stream and behind the fold of a finished table, whatever the batches. The two differ only
by events that are older than the watermark, which the stream doesn't see.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructField, StructType

from folioscan.operators.library import FAILED, IN_FLIGHT, STATES
from folioscan.streaming.ingest import append_once

DELETED = "DELETED"
#: State stores that keep timers and several variables for a key.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LOG = "n int, at timestamp, before string, after string, outcome string, reason string"
MOVED, REFUSED, IGNORED = "moved", "refused", "ignored"


@dataclass(frozen=True)
class State:
    """n: how many lines of log the document has; due: when its timer ends, in ms."""

    name: str
    at: int
    due: int
    n: int


@dataclass(frozen=True)
class Limits:
    """How long a document may stay in one state, and how long it is known after its end, in ms."""

    stuck: int = 3_600_000
    known: int = 86_400_000

    def state(self, name: str, at: int, n: int) -> State:
        return State(name, at, at + (self.stuck if name in IN_FLIGHT else self.known), n)


Line = tuple[int, int, str | None, str | None, str, str | None]


def expire(state: State | None, now: int, limits: Limits) -> tuple[State | None, list[Line]]:
    """The state at a time, if nothing happens until then: a stuck document fails when its timer ends, one that has ended is forgotten."""
    lines: list[Line] = []
    while state is not None and now > state.due:
        if state.name not in IN_FLIGHT:
            return None, lines
        lines.append((state.n + 1, state.due, state.name, FAILED, MOVED, f"stuck in {state.name}"))
        state = limits.state(FAILED, state.due, state.n + 1)
    return state, lines


def step(state: State | None, at: int, event: str, reason: str | None, limits: Limits) -> tuple[State | None, list[Line]]:
    """The state after an event, and the log's new lines."""
    state, lines = expire(state, at, limits)
    if state is None:
        if event == STATES[0]:
            return limits.state(event, at, 1), [*lines, (1, at, None, event, MOVED, reason)]
        return None, [*lines, (0, at, None, event, IGNORED, "no such document")]
    n, was = state.n + 1, state.name
    if was == DELETED:
        return State(was, state.at, state.due, n), [*lines, (n, at, was, event, IGNORED, "deleted")]
    if at < state.at:
        return State(was, state.at, state.due, n), [*lines, (n, at, was, event, REFUSED, "late")]
    if event == DELETED or was in IN_FLIGHT and event in (FAILED, STATES[STATES.index(was) + 1]):
        return limits.state(event, at, n), [*lines, (n, at, was, event, MOVED, reason)]
    return State(was, state.at, state.due, n), [*lines, (n, at, was, event, REFUSED, "no such step")]


def _ms(at: dt.datetime) -> int:
    return round(at.timestamp() * 1000)


def _time(ms: int) -> dt.datetime:
    return dt.datetime.fromtimestamp(ms / 1000)


class Lifecycle(StatefulProcessor):
    """`step` over a key's rows (at, seq, event, reason), with its state in a store."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("document", "name string, at long, due long, n int")

    def _now(self) -> State | None:
        held = self.held.get()  # one call of the store, None for a key that has no state
        return State(*held) if held is not None else None

    def _put(self, before: State | None, after: State | None) -> None:
        if before is not None and (after is None or after.due != before.due):
            self.handle.deleteTimer(before.due + 1)
        if after is None:
            self.held.clear()
        elif after != before:
            self.held.update((after.name, after.at, after.due, after.n))
            if before is None or after.due != before.due:
                self.handle.registerTimer(after.due + 1)

    def _lines(self, key: tuple, lines: Iterable[Line]) -> Iterator[Row]:
        for n, at, before, after, outcome, reason in lines:
            yield Row(key=key[0], n=n, at=_time(at), before=before, after=after, outcome=outcome, reason=reason)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = state = self._now()
        out: list[Line] = []
        for r in sorted(rows, key=lambda r: r["seq"]):  # a document's events of one batch
            state, lines = step(state, _ms(r["at"]), r["event"], r["reason"], self.limits)
            out += lines
        self._put(before, state)
        yield from self._lines(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = self._now()
        after, lines = expire(before, expiredTimerInfo.getExpiryTimeInMs(), self.limits)
        if after != before:
            self._put(before, after)
        yield from self._lines(key, lines)

    def close(self) -> None:
        pass


def _log_type(events: DataFrame) -> StructType:
    return StructType([StructField("key", events.schema["key"].dataType), *StructType.fromDDL(LOG).fields])


def transitions(events: DataFrame, limits: Limits = Limits(), late: str = "30 minutes") -> DataFrame:
    """The log (key, n, at, before, after, outcome, reason) of a stream of events (key, at timestamp, seq, event, reason).

    A document's events of one batch are taken by seq. `late` is how far an event may be behind the latest of all. Events
    without a key or a time are passed over."""
    stream = events.where("key IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    return stream.groupBy("key").transformWithState(Lifecycle(limits), _log_type(events), "Append", "EventTime")


def run_transitions(events: DataFrame, path: str, checkpoint: str, limits: Limits = Limits(), late: str = "30 minutes") -> StreamingQuery:
    """Adds what is there now to the log at path; the same checkpoint goes on where the last run ended."""
    spark = events.sparkSession
    key, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(key, ROCKS)  # a query keeps the provider that it was started with
    try:
        return append_once(transitions(events, limits, late), path, checkpoint)
    finally:
        spark.conf.set(key, before)


def fold_events(events: DataFrame, limits: Limits = Limits(), late: str = "30 minutes") -> DataFrame:
    """The same log of a finished table, by seq for each document; timers end as the watermark of the whole table has it."""
    held = events.where("key IS NOT NULL AND at IS NOT NULL")
    end = held.agg((F.max("at") - F.expr(f"INTERVAL {late}")).alias("end")).first()["end"]
    now = _ms(end) if end else 0

    def fold(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        state, out = None, []
        for r in b.sort_values("seq", kind="stable").itertuples(index=False):  # one document's events
            state, lines = step(state, _ms(r.at), r.event, r.reason, limits)
            out += lines
        out += expire(state, now, limits)[1]
        rows = [(key[0], n, _time(at), before, after, outcome, reason) for n, at, before, after, outcome, reason in out]
        return pd.DataFrame(rows, columns=["key", "n", "at", "before", "after", "outcome", "reason"])

    return held.groupBy("key").applyInPandas(fold, _log_type(events))


def current_states(log: DataFrame) -> DataFrame:
    """(key, state, at, reason, refused): where the log's last move left each document, and how many of its events were refused; deleted ones too."""
    moved = F.col("outcome") == MOVED
    last = F.max(F.when(moved, F.struct("at", "n", "after", "reason"))).alias("_l")
    out = log.groupBy("key").agg(last, F.count(F.when(F.col("outcome") == REFUSED, 1)).alias("refused")).where("_l IS NOT NULL")
    return out.select("key", F.col("_l.after").alias("state"), F.col("_l.at").alias("at"), F.col("_l.reason").alias("reason"), "refused")

"""Undo histories of sessions over a stream: state by transformWithState, in order of event time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import LongType, StructField, StructType

from leafmill.operators.pages import History


class _Undo(StatefulProcessor):
    """State of a session: its history's states, the cursor and last stamp, and the rows that the watermark has not passed."""

    def __init__(self, keep: int, ttl_ms: int, state: StructField, ahead: StructType, out: tuple[str, ...]):
        self.keep, self.ttl, self.state, self.ahead_type, self.out = keep, ttl_ms, state, ahead, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = handle.getListState("states", StructType([self.state]))
        self.cursor = handle.getValueState("cursor", "at long, last long")
        self.ahead = handle.getListState("ahead", self.ahead_type)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        new = [(r.t, r.seq, r.kind, r.state) for r in rows]
        self.ahead.appendList(new)
        self.handle.registerTimer(-(-min(r[0] for r in new) // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        ahead = [tuple(r) for r in self.ahead.get()] if self.ahead.exists() else []
        due = sorted((r for r in ahead if r[0] <= now), key=lambda r: r[:3])
        at, last = self.cursor.get() if self.cursor.exists() else (-1, None)
        if not due:
            if not ahead and last is not None and last + self.ttl * 1000 <= now:
                for held in (self.states, self.cursor, self.ahead):
                    held.clear()
            return
        gone = last is not None and due[0][0] - last >= self.ttl * 1000  # went before this row, whichever timer comes first
        history = History(self.keep, [s for (s,) in self.states.get()] if self.states.exists() and not gone else [], -1 if gone else at)
        for k, (t, _, kind, state) in enumerate(due):
            if k and t - due[k - 1][0] >= self.ttl * 1000:
                history = History(self.keep)
            history.do(kind, state)
        for held, values in ((self.states, [(s,) for s in history.states]), (self.ahead, [r for r in ahead if r[0] > now])):
            if values:
                held.put(values)
            else:
                held.clear()
        self.cursor.update((history.at, due[-1][0]))
        self.handle.registerTimer(-(-due[-1][0] // 1000) + self.ttl)
        if rest := [r[0] for r in ahead if r[0] > now]:
            self.handle.registerTimer(-(-min(rest) // 1000))
        yield Row(**dict(zip(self.out, (key[0], *history.shown()), strict=True)))

    def close(self) -> None:
        pass


def replay_history_stream(log: DataFrame, keep: int = 50, late: str = "10 minutes", ttl_hours: float = 24 * 30) -> DataFrame:
    """replay_history over a stream of session, ts, seq, kind and state, in update mode: session, n_states, cursor, current.

    Rows wait until the watermark has passed their ts, and are then done in order of ts and
    seq, so they may come in any order within late; later ones are dropped (LateRows counts
    them). A session has a row each time that some of its rows are done. State of a session:
    its newest keep states, the cursor, and the rows that wait; a timer of event time clears
    it ttl_hours after its last row, and what comes then begins a new history. A null session
    is one session. Needs a state store that has timers: set spark.sql.streaming.stateStore.providerClass
    to the RocksDB one.
    """
    fields = log.schema
    session, state = fields["session"], StructField("state", fields["state"].dataType)
    ahead = StructType([StructField("t", LongType()), StructField("seq", fields["seq"].dataType), StructField("kind", fields["kind"].dataType), state])
    out = StructType([session, StructField("n_states", LongType()), StructField("cursor", LongType()), StructField("current", state.dataType)])
    rows = log.withWatermark("ts", late).select("session", "ts", F.unix_micros("ts").alias("t"), "seq", "kind", "state")
    undo = _Undo(keep, int(ttl_hours * 3_600_000), state, ahead, tuple(out.names))
    return rows.groupBy("session").transformWithState(undo, out, "Update", "EventTime")

"""Queues as keyed state with timers: failed work put back after a pause, and single runs held by a lease.

Events have a key, ts (watermarked), seq (decides between equal times) and kind. What comes out does not depend on how the
events fall into batches: what was due before an event is said before it, be it by the timer or, if the batch has both, in
handling the event. Keys that have come to an end are forgotten after keep_ms.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

FOREVER = 1 << 61


class _Timed(StatefulProcessor):
    """step() and due() are the automaton: they take the state and give the next one with what is said (at, what, number, until)."""

    STATE = "status string, number int, until long"

    def __init__(self, key: str, keep_ms: int):
        self.key, self.keep_ms = key, keep_ms

    def init(self, handle) -> None:
        self.handle, self.kept = handle, handle.getValueState("kept", self.STATE)

    def close(self) -> None:
        pass

    def _save(self, before: tuple, now: tuple) -> None:
        """A state's until is its timer."""
        if before[2] and before[2] != now[2]:
            self.handle.deleteTimer(before[2])
        if now[0] is None:
            self.kept.clear()
            return
        self.kept.update(now)
        if now[2] and before[2] != now[2] and now[2] < FOREVER:
            self.handle.registerTimer(now[2])

    def _said(self, key, said: list[tuple]) -> Iterator[Row]:
        for at, what, number, until in said:
            yield Row(**{self.key: key[0], "at": at, "action": what, "number": number, "until": until})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = now = tuple(self.kept.get()) if self.kept.exists() else (None, 0, 0)
        said: list[tuple] = []
        for row in sorted(rows, key=lambda r: (r.at, r.seq)):
            if now[2] and now[2] <= row.at:
                now, more = self.due(now)
                said += more
            now, more = self.step(now, row.at, row.kind)
            said += more
        self._save(before, now)
        yield from self._said(key, said)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = tuple(self.kept.get()) if self.kept.exists() else (None, 0, 0)
        if before[2] != expiredTimerInfo.getExpiryTimeInMs():
            return
        now, said = self.due(before)
        self._save((*before[:2], 0), now)
        yield from self._said(key, said)

    def end(self, status: str, number: int, at: int) -> tuple:
        return status, number, at + self.keep_ms if self.keep_ms < FOREVER else 0


class Retries(_Timed):
    """Kinds: ok, transient, permanent; each is the outcome of one try of the key's work.

    A transient failure waits for base_ms, then twice as long each time, and is put back (retry); after `most` retries it has
    failed. A permanent one is rejected at once. What comes for work that has ended is passed over; an outcome that comes
    before the pause is over is that of the next try, which is then not put back again.
    """

    def __init__(self, key: str, most: int, base_ms: int, keep_ms: int):
        super().__init__(key, keep_ms)
        self.most, self.base_ms = most, base_ms

    def step(self, state: tuple, t: int, kind: str) -> tuple[tuple, list[tuple]]:
        status, tries, until = state
        if status in ("complete", "rejected", "failed"):
            return state, []
        tries += 1
        if kind == "transient" and tries <= self.most:
            until = t + self.base_ms * 2 ** (tries - 1)
            return ("waiting", tries, until), [(t, "waiting", tries, until)]
        status = {"ok": "complete", "permanent": "rejected"}.get(kind, "failed")
        return self.end(status, tries, t), [(t, status, tries, None)]

    def due(self, state: tuple) -> tuple[tuple, list[tuple]]:
        status, tries, until = state
        if status == "waiting":
            return ("running", tries, 0), [(until, "retry", tries, None)]
        return (None, 0, 0), []


class SingleRuns(_Timed):
    """Kinds: submit, beat, done, error. One run of a key at a time, which holds its lease as long as it beats.

    A submit starts a run, or joins the one that is running, or finds the finished one. A run whose lease lapses is a ghost:
    its worker has died, and the next submit starts another run. What a ghost says later is passed over.
    """

    def __init__(self, key: str, lease_ms: int, keep_ms: int):
        super().__init__(key, keep_ms)
        self.lease_ms = lease_ms

    def step(self, state: tuple, t: int, kind: str) -> tuple[tuple, list[tuple]]:
        status, run, until = state
        if kind == "submit":
            if status == "running":
                return state, [(t, "joined", run, until)]
            if status == "done":
                return state, [(t, "finished", run, None)]
            return ("running", run + 1, t + self.lease_ms), [(t, "started", run + 1, t + self.lease_ms)]
        if status != "running":
            return state, []
        if kind == "beat":
            return ("running", run, t + self.lease_ms), []
        return self.end(kind, run, t), [(t, kind, run, None)]

    def due(self, state: tuple) -> tuple[tuple, list[tuple]]:
        status, run, until = state
        if status == "running":
            return self.end("ghost", run, until), [(until, "ghost", run, None)]
        return (None, 0, 0), []


def _run(events: DataFrame, key: str, machine: _Timed) -> DataFrame:
    rows = events.select(key, "ts", F.unix_millis("ts").alias("at"), "seq", "kind")
    return rows.groupBy(key).transformWithState(machine, f"{key} {events.schema[key].dataType.simpleString()}, at long, action string, number int, until long", "append", "EventTime")


def retries(events: DataFrame, key: str, most: int = 3, base_ms: int = 30_000, keep_ms: int = FOREVER) -> DataFrame:
    """key, at (ms), action (waiting, retry, complete, rejected, failed), number (of tries), until; see Retries."""
    return _run(events, key, Retries(key, most, base_ms, keep_ms))


def single_runs(events: DataFrame, key: str, lease_ms: int, keep_ms: int = FOREVER) -> DataFrame:
    """key, at (ms), action (started, joined, finished, done, error, ghost), number (of the run), until; see SingleRuns."""
    return _run(events, key, SingleRuns(key, lease_ms, keep_ms))


def job_table(said: DataFrame, key: str, now_ms: int) -> DataFrame:
    """key, status, number: the state of each job from what single_runs said until now; a lease that has lapsed is a ghost."""
    told = said.where((F.col("at") <= now_ms) & ~F.col("action").isin("joined", "finished"))
    last = told.groupBy(key).agg(F.max_by(F.struct("action", "number", "until"), F.struct("number", "at")).alias("r"))
    status = F.when(F.col("r.action") != "started", F.col("r.action")).otherwise("running")
    return last.select(key, status.alias("status"), F.col("r.number").alias("number"))

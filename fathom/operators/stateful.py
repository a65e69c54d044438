"""Automata over the rows of a key in order, where no window will do.

Rows are dealt by key and sorted; a task reads them as a stream of batches of bounded size and carries the state of the key
that it is in over the ends of batches. So a key with most of the rows takes time, but no more memory than any other.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import stats


class Machine(Protocol):
    """step() takes the columns of a row after the key, end() the key's end; both give rows of the output after the key."""

    def step(self, *row) -> Iterable[tuple]: ...

    def end(self) -> Iterable[tuple]: ...


def scan(df: DataFrame, key: str, columns: list[str], order: list, machine: Callable[[], Machine], output: str, most: int = 8192) -> DataFrame:
    """key and output: what a machine of its own says to each key's rows (columns) in that order."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *T.StructType.fromDDL(output).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held, at = None, None

        def full() -> pa.RecordBatch:
            rows = list(zip(*out, strict=True)) or [()] * len(arrow)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or k != at:
                    if held is not None:
                        out += [(at, *x) for x in held.end()]
                    held, at = machine(), k
                out += [(k, *x) for x in held.step(*row)]
                if len(out) >= most:
                    yield full()
        if held is not None:
            out += [(at, *x) for x in held.end()]
        yield full()

    return df.repartition(key).sortWithinPartitions(key, *order).select(key, *columns).mapInArrow(run, schema)


class FixedWindows:
    """A window begins with the first hit after the last one ended."""

    def __init__(self, seconds: float, limit: int):
        self.seconds, self.limit = seconds, limit
        self.start, self.hits, self.window = None, 0, -1

    def step(self, t: float, order) -> Iterable[tuple]:
        if self.start is None or t - self.start >= self.seconds:
            self.start, self.hits, self.window = t, 0, self.window + 1
        self.hits += 1
        return ((order, self.window, self.hits, self.hits <= self.limit),)

    def end(self) -> Iterable[tuple]:
        return ()


def fixed_windows(df: DataFrame, key: str, time: str, order: str, seconds: float, limit: int) -> DataFrame:
    """Rate windows of each key: number of the window, count so far, allowed."""
    kind = df.schema[order].dataType.simpleString()
    return scan(df, key, [time, order], [time, order], lambda: FixedWindows(seconds, limit), f"{order} {kind}, win int, hits int, allowed boolean")


class RunningMedian:
    """The median of what was added, by two heaps."""

    def __init__(self):
        self.low: list[float] = []
        self.high: list[float] = []

    def add(self, x: float) -> None:
        if self.low and x > -self.low[0]:
            heapq.heappush(self.high, x)
        else:
            heapq.heappush(self.low, -x)
        if len(self.low) > len(self.high) + 1:
            heapq.heappush(self.high, -heapq.heappop(self.low))
        elif len(self.high) > len(self.low):
            heapq.heappush(self.low, -heapq.heappop(self.high))

    def value(self) -> float:
        return -self.low[0] if len(self.low) > len(self.high) else (self.high[0] - self.low[0]) / 2


class Note:
    """The frames of a note: what is left of them is its times, its median and its sum of confidences."""

    def __init__(self, frames: list[tuple[float, float, float]]):
        self.start, self.confidence, self.n, self.median = frames[0][0], 0.0, 0, RunningMedian()
        for x in frames:
            self.add(*x)

    def add(self, t: float, cents: float, confidence: float) -> None:
        self.last, self.confidence, self.n = t, self.confidence + confidence, self.n + 1
        self.median.add(cents)


class SettledNotes:
    """A note goes on through excursions until these settle elsewhere for `settle` frames, or a pause is longer than the gap."""

    def __init__(self, voicing: float, split: float, settle: int, least: float, gap: float):
        self.voicing, self.split, self.settle, self.least, self.gap = voicing, split, settle, least, gap
        self.note: Note | None = None
        self.away: list[tuple[float, float, float]] = []
        self.hop = 0.0

    def close(self) -> Iterable[tuple]:
        note = self.note
        if note and note.last + self.hop - note.start >= self.least:
            yield note.start, note.last + self.hop, note.median.value(), note.confidence / note.n

    def step(self, t: float, cents: float | None, confidence: float, hop: float) -> Iterable[tuple]:
        self.hop = hop
        if cents is not None and np.isfinite(cents) and confidence >= self.voicing:
            if self.note is None:
                self.note = Note([(t, cents, confidence)])
            elif abs(cents - self.note.median.value()) < self.split:
                for x in (*self.away, (t, cents, confidence)):
                    self.note.add(*x)
                self.away = []
            else:
                self.away.append((t, cents, confidence))
                if len(self.away) >= self.settle:
                    yield from self.close()
                    self.note, self.away = Note(self.away), []
        elif not (self.note and t - (self.away[-1][0] if self.away else self.note.last) <= self.gap):
            yield from self.end()

    def end(self) -> Iterable[tuple]:
        if self.note:
            for x in self.away:
                self.note.add(*x)
            yield from self.close()
        self.note, self.away = None, []


def settle_notes(frames: DataFrame, key: str, voicing: float = 0.5, split: float = 80.0, settle: int = 12, least: float = 0.08, gap: float = 0.06) -> DataFrame:
    """Notes of a pitch ribbon (key, t, cents, conf): start, end, median cents, mean confidence. A note lasts to the end of its
    last frame, whose length is the median step of the key's frames."""
    steps = frames.select(key, (F.col("t") - F.lag("t").over(Window.partitionBy(key).orderBy("t"))).alias("hop")).where("hop IS NOT NULL")
    hops = stats.quantiles(steps, "hop", [key], [0.5]).select(key, F.col("p50").alias("hop"))
    rows = frames.select(key, "t", "cents", "conf").join(hops, key, "left").fillna(0.0, ["hop"])
    return scan(rows, key, ["t", "cents", "conf", "hop"], ["t"], lambda: SettledNotes(voicing, split, settle, least, gap), "start double, end double, cents double, confidence double")


class Skyline:
    """One line of notes: a sounding note gives way only to a decidedly louder one."""

    def __init__(self, ratio: float, least: float):
        self.ratio, self.least = ratio, least
        self.top: tuple[float, float, float] | None = None

    def step(self, start: float, end: float, amp: float) -> Iterable[tuple]:
        if self.top and start < self.top[1]:
            if amp <= self.top[2] * self.ratio:
                return
            self.top = (self.top[0], start, self.top[2])
        yield from self.end()
        self.top = (start, end, amp)

    def end(self) -> Iterable[tuple]:
        if self.top and self.top[1] - self.top[0] >= self.least:
            yield self.top


def skyline(notes: DataFrame, key: str, ratio: float = 1.2, least: float = 0.05) -> DataFrame:
    """The skyline of notes (key, start, end, amp); shorter notes than the least are left out."""
    return scan(notes, key, ["start", "end", "amp"], ["start", F.desc("amp"), "end"], lambda: Skyline(ratio, least), "start double, end double, amp double")


class LagPitch:
    """Fundamental by autocorrelation: the first strong local peak. A key's samples are one excerpt, which is held."""

    def __init__(self, rate: float, low: float, high: float):
        self.rate, self.low, self.high = rate, low, high
        self.x: list[float] = []

    def step(self, x: float) -> Iterable[tuple]:
        self.x.append(x)
        return ()

    def end(self) -> Iterable[tuple]:
        x = np.array(self.x) - np.mean(self.x)
        energy = float(x @ x)
        a, b = max(1, int(self.rate // self.high)), min(int(self.rate // self.low), len(x) - 1)
        hz = None
        if energy > 1e-12 and b > a:
            r = np.array([x[: len(x) - k] @ x[k:] for k in range(a, b + 1)]) / energy
            top = r.max()
            if top > 0.3:
                peak = next(k for k in range(len(r)) if r[k] >= 0.9 * top and (k == 0 or r[k] >= r[k - 1]) and (k + 1 == len(r) or r[k] >= r[k + 1]))
                hz = self.rate / (a + peak)
        return ((hz,),)


def lag_pitch(samples: DataFrame, key: str, rate: float, low: float = 60.0, high: float = 1000.0) -> DataFrame:
    """hz of each key's samples (key, i, x)."""
    return scan(samples, key, ["x"], ["i"], lambda: LagPitch(rate, low, high), "hz double")

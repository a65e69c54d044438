"""Gated loudness of samples, and the gain that brings them to a target without clipping.

Samples are weighted by two recursive filters, which run over a key's samples in order. The filters are linear, so a key needs no
single task: its sorted samples are cut into pieces, each is filtered from rest, and what the four states at its start add is known
from the pieces before it (a scan over one row a piece). What leaves the filters are energies of steps of 100 ms. Blocks of four
steps and the two gates are windows and aggregates over those.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.sources import writers

from .stateful import scan

#: The weighting (a shelf of so many dB from a frequency on, and a high pass, each with its quality), the offset of
#: the scale, the two gates, the share of a block that a step is; and the peak and the loudness that are aimed at.
SHELF_DB, SHELF_Q, SHELF_HZ, PASS_Q, PASS_HZ = 4.0, 1 / math.sqrt(2), 1500.0, 0.5, 38.0
OFFSET, SILENCE, BELOW_MEAN, STEPS = -0.691, -70.0, -10.0, 4
PEAK, TARGET = 0.99, -14.0
#: Samples of a piece, and those that a task sorts, about.
PIECE, SORTED = 1 << 16, 1_000_000


def filters(rate: float) -> list[tuple[float, float, float, float, float]]:
    """b0, b1, b2, a1, a2 of the shelf and of the high pass."""
    a, w = 10 ** (SHELF_DB / 40), 2 * math.pi * SHELF_HZ / rate
    c, alpha = math.cos(w), math.sin(w) / (2 * SHELF_Q)
    root = 2 * math.sqrt(a) * alpha
    a0 = (a + 1) - (a - 1) * c + root
    shelf = (a * ((a + 1) + (a - 1) * c + root), -2 * a * ((a - 1) + (a + 1) * c), a * ((a + 1) + (a - 1) * c - root), 2 * ((a - 1) - (a + 1) * c), (a + 1) - (a - 1) * c - root)
    w = 2 * math.pi * PASS_HZ / rate
    c, alpha = math.cos(w), math.sin(w) / (2 * PASS_Q)
    high = ((1 + c) / 2, -(1 + c), (1 + c) / 2, -2 * c, 1 - alpha)
    return [tuple(x / a0 for x in shelf), tuple(x / (1 + alpha) for x in high)]


class Weighted:
    """The filters in a row; says step and energy whenever a step is full."""

    def __init__(self, rate: float):
        self.coefficients, self.length = filters(rate), round(rate / 10)
        self.states = [[0.0, 0.0], [0.0, 0.0]]
        self.n, self.step_no, self.energy = 0, 0, 0.0

    def step(self, x: float | None) -> Iterable[tuple]:
        x = x or 0.0
        for (b0, b1, b2, a1, a2), s in zip(self.coefficients, self.states, strict=True):
            y = b0 * x + s[0]
            s[0], s[1] = b1 * x - a1 * y + s[1], b2 * x - a2 * y
            x = y
        self.energy += x * x
        self.n += 1
        if self.n < self.length:
            return ()
        out = ((self.step_no, self.energy / self.length),)
        self.n, self.step_no, self.energy = 0, self.step_no + 1, 0.0
        return out

    def end(self) -> Iterable[tuple]:
        return ()


class Linear:
    """The two filters on arrays: `length` samples at once, as products with their response to a sample and to a state."""

    def __init__(self, rate: float):
        self.length = round(rate / 10)
        one = Weighted(rate)
        one.length = self.length + 1  # no step ends

        def run(state: list[float], xs: Iterable[float]) -> tuple[list[float], list[list[float]]]:
            """What leaves the filters, and the states after each sample."""
            one.states, out, after = [state[:2], state[2:]], [], []
            for x in xs:
                one.energy, one.n = 0.0, 0
                for (b0, b1, b2, a1, a2), s in zip(one.coefficients, one.states, strict=True):
                    y = b0 * x + s[0]
                    s[0], s[1] = b1 * x - a1 * y + s[1], b2 * x - a2 * y
                    x = y
                out.append(x)
                after.append([z for s in one.states for z in s])
            return out, after

        n = self.length
        pulse, after = run([0.0] * 4, [1.0] + [0.0] * (n - 1))
        lag = np.arange(n)[None, :] - np.arange(n)[:, None]
        self.of_samples = np.where(lag >= 0, np.array(pulse)[np.maximum(lag, 0)], 0.0)  # [sample, what leaves]
        self.pulse_state = np.array(after)[::-1]  # of a sample k before the end: [n - 1 - k]
        rests = [run([float(k == j) for j in range(4)], [0.0] * n) for k in range(4)]
        self.of_state = np.array([out for out, _ in rests])  # [state, what leaves]
        self.moved = np.concatenate([np.eye(4)[None], np.array([a for _, a in rests]).transpose(1, 0, 2)])  # [samples, state, state after]

    def run(self, x: np.ndarray, state: np.ndarray, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Sums of squares of steps (the first of which lacks `first` samples, the last maybe some), and the states at the end."""
        n = self.length
        parts = [x[: n - first]] if first else []
        rest = x[n - first if first else 0 :]
        whole, tail = rest[: len(rest) // n * n].reshape(-1, n), rest[len(rest) // n * n :]
        sums = []

        def short(part: np.ndarray) -> None:
            nonlocal state
            m = len(part)
            y = part @ self.of_samples[:m, :m] + state @ self.of_state[:, :m]
            sums.append(np.array([y @ y]))
            state = state @ self.moved[m] + part @ self.pulse_state[n - m :]

        for part in parts:
            short(part)
        if len(whole):
            own, states = whole @ self.pulse_state, np.empty((len(whole), 4))
            for k, add in enumerate(own):
                states[k] = state
                state = state @ self.moved[n] + add
            y = whole @ self.of_samples + states @ self.of_state
            sums.append((y * y).sum(axis=1))
        if len(tail):
            short(tail)
        return np.concatenate(sums) if sums else np.zeros(0), state

    def moved_by(self, n: int) -> np.ndarray:
        return np.linalg.matrix_power(self.moved[self.length], n // self.length) @ self.moved[n % self.length]


class Starts:
    """The number of samples and the states before each piece of a key."""

    def __init__(self, linear: Linear):
        self.linear, self.before, self.state = linear, 0, np.zeros(4)

    def step(self, part: int, number: int, n: int, state: list[float]) -> Iterable[tuple]:
        out = ((part, number, self.before, self.state.tolist()),)
        self.before, self.state = self.before + n, self.state @ self.linear.moved_by(n) + np.array(state)
        return out

    def end(self) -> Iterable[tuple]:
        return ()


def _pieces(samples: DataFrame, key: str, linear: Linear, piece: int, sorted_: int) -> DataFrame:
    """key, part, number, n, state (after the piece, from rest), x: a row a piece, in order of part and number; written once."""
    spark, kind = samples.sparkSession, samples.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, part int, number int, n long, state array<double>, x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at, part, number, size = None, 0, 0, 0

        def full() -> pa.RecordBatch:
            nonlocal number, size
            x = np.concatenate(held)
            state = linear.run(x, np.zeros(4))[1]
            row = [pa.array([at], of), pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([state.tolist()]), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))]
            held.clear()
            number, size = number + 1, 0
            return pa.RecordBatch.from_arrays(row, names=[key, "part", "number", "n", "state", "x"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, of = batch[key], batch[key].type
            x, part = batch["x"].fill_null(0.0).to_numpy(zero_copy_only=False), batch["part"][0].as_py()
            runs = keys.dictionary_encode("encode").indices.to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(x)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                k = keys[a].as_py()
                if held and k != at:
                    yield full()
                at = k
                while a < b:
                    c = min(b, a + piece - size)
                    held.append(x[a:c].copy())
                    size, a = size + c - a, c
                    if size == piece:
                        yield full()
        if held:
            yield full()

    tasks = max(1, -(-samples.count() // sorted_))
    rows = samples.repartitionByRange(tasks, key, "i").sortWithinPartitions(key, "i").select(key, F.col("x").cast("double").alias("x"), F.spark_partition_id().alias("part"))
    path = writers.scratch(spark)
    rows.mapInArrow(run, schema).write.parquet(f"{path}/pieces")
    return spark.read.schema(schema).parquet(f"{path}/pieces")


def step_energies(samples: DataFrame, key: str, rate: float, piece: int = PIECE, sorted_: int = SORTED) -> DataFrame:
    """key, step, energy of each full step of the weighted samples (key, i, x)."""
    linear, kind = Linear(rate), samples.schema[key].dataType.simpleString()
    pieces = _pieces(samples, key, linear, piece, sorted_)
    starts = scan(pieces.select(key, "part", "number", "n", "state"), key, ["part", "number", "n", "state"], ["part", "number"], lambda: Starts(linear), "part int, number int, before long, start array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                before, x = batch["before"][k].as_py(), batch["x"][k].values.to_numpy()
                sums, _ = linear.run(x, np.array(batch["start"][k].as_py()), before % linear.length)
                steps = before // linear.length + np.arange(len(sums))
                ends = np.minimum((steps + 1) * linear.length, before + len(x))
                n = ends - np.maximum(steps * linear.length, before)
                yield pa.RecordBatch.from_arrays([pa.repeat(batch[key][k], len(sums)), pa.array(steps), pa.array(sums), pa.array(n)], names=[key, "step", "energy", "n"])

    # broadcast: a row of six numbers for each 65,536 samples, joined by a piece's unique place (null keys have pieces, too)
    found = pieces.withColumnRenamed(key, "_key").join(F.broadcast(starts.drop(key)), ["part", "number"]).select(F.col("_key").alias(key), "before", F.col("start"), "x")
    parts = found.mapInArrow(run, f"{key} {kind}, step long, energy double, n long")
    return parts.groupBy(key, "step").agg((F.sum("energy") / linear.length).alias("energy"), F.sum("n").alias("n")).where(F.col("n") == linear.length).drop("n")


def _level(energy):
    return OFFSET + 10 * F.log10(energy)


def integrated(samples: DataFrame, key: str, rate: float) -> DataFrame:
    """key, loudness of the samples (key, i, x): the level of the blocks of 400 ms that are neither silent nor 10 below the mean
    level of those. Null for keys without such a block; null samples are silence."""
    steps = step_energies(samples, key, rate)
    w = Window.partitionBy(key).orderBy("step")
    block = sum((F.lead("energy", k).over(w) for k in range(1, STEPS)), F.col("energy")) / STEPS
    blocks = steps.select(key, block.alias("z")).where(F.col("z") > 0).where(_level(F.col("z")) >= SILENCE)
    gate = blocks.groupBy(key).agg((_level(F.avg("z")) + BELOW_MEAN).alias("gate"))
    level = blocks.join(gate, key).where(_level(F.col("z")) > F.col("gate")).groupBy(key).agg(_level(F.avg("z")).alias("loudness"))
    return samples.select(key).distinct().join(level, key, "left")


def gains(samples: DataFrame, key: str, rate: float, target: float = TARGET, peak: float = PEAK) -> DataFrame:
    """key, loudness (after the peak was brought to `peak`), gain (the factor for each sample), limited (the target would have
    clipped, so the gain stops at the peak). Without loudness the gain only sets the peak."""
    top = samples.groupBy(key).agg(F.greatest(F.max(F.abs("x")), F.lit(1e-9)).alias("_top"))
    first = peak / F.col("_top")
    j = top.join(integrated(samples, key, rate), key).withColumn("loudness", F.col("loudness") + 20 * F.log10(first))
    wanted = F.coalesce(F.pow(F.lit(10.0), (target - F.col("loudness")) / 20), F.lit(1.0))
    return j.select(key, "loudness", (first * F.least(wanted, F.lit(1.0))).alias("gain"), (wanted > 1).alias("limited"))

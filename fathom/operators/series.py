"""Frame series: gates, note events, histograms, tonic, conformity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc_
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import pitch


def gate(frames: DataFrame, threshold: float = 0.8) -> DataFrame:
    return frames.where((F.col("conf") >= threshold) & (F.col("hz") > 0))


def mapped(frames: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Gated frames with note and cents."""
    return gate(frames, threshold).withColumn("d", pitch.nearest_degree(F.col("hz"))).select("*", "d.note", "d.cents").drop("d")


def note_statistics(points: DataFrame, key: str = "track") -> DataFrame:
    """Per track and degree: count, share of the confidence, mean cents; nothing for tracks without confidence.

    Confidences are summed as decimals of nine places: such a sum is the same in any order, so a share on the edge between
    two roundings always falls to the same side.
    """
    weight = F.sum(F.col("conf").cast("decimal(18,9)"))
    by = points.groupBy(key, "note").agg(F.count(F.lit(1)).alias("n"), weight.alias("weight"), F.avg("cents").alias("mean_cents"))
    whole = by.withColumn("total", F.sum("weight").over(Window.partitionBy(key)))
    return whole.where("total > 0").withColumn("share", F.col("weight").cast("double") / F.col("total").cast("double")).drop("weight", "total")


def islands(df: DataFrame, key: str, order: list[str], label: str, time: str | None = None, gap: float | None = None) -> DataFrame:
    """Numbers runs of equal labels; a gap in time beyond the limit starts a new run, too."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.lag(label).over(w).isNull() | (F.lag(label).over(w) != F.col(label))
    if gap is not None:
        new = new | (F.col(time) - F.lag(time).over(w) > gap)
    return df.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def note_events(points: DataFrame, gap: float = 0.05, key: str = "track") -> DataFrame:
    """Runs of one degree: start, end, number of frames, first, last, least and largest cents."""
    runs = islands(points, key, ["t", "ord"], "note", "t", gap)
    at = F.struct("t", "ord")
    return runs.groupBy(key, "island").agg(
        F.first("note").alias("note"), F.min("t").alias("start"), F.max("t").alias("end"), F.count(F.lit(1)).alias("n"),
        F.min_by("cents", at).alias("first_cents"), F.max_by("cents", at).alias("last_cents"), F.min("cents").alias("low"), F.max("cents").alias("high"),
        F.transform(F.array_sort(F.collect_list(F.struct("t", "ord", "cents"))), lambda x: x["cents"]).alias("cents"),
    )


def zero_crossings(cents: Column) -> Column:
    """Sign changes of the series without its trend and mean (the sign bit counts, as for -0.0)."""
    c = detrended(cents)
    neg = F.transform(c, lambda x: x < 0)
    return F.aggregate(F.zip_with(F.slice(neg, 1, F.size(neg) - 1), F.slice(neg, 2, F.size(neg) - 1), lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, x: s + x)


def detrended(cents: Column) -> Column:
    n = F.size(cents)
    line = F.transform(cents, lambda x, i: x - (F.element_at(cents, 1) + (F.element_at(cents, -1) - F.element_at(cents, 1)) * i / (n - 1)))
    mean = F.aggregate(line, F.lit(0.0), lambda s, x: s + x) / n
    return F.transform(line, lambda x: x - mean)


def percentile_of(values: Column, q: float) -> Column:
    """Interpolated percentile of an array."""
    s = F.array_sort(values)
    at = (F.size(s) - 1) * q
    low = F.floor(at).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
    return a + (b - a) * (at - low)


#: The limits of ornaments. Seconds of a grace note (less) and of a glissando (least), cents of a glissando, of a
#: vibrato's depth and of a straight note; frames and turns a second of a vibrato.
GRACE_S, GLIDE_S, GLIDE_CENTS, VIBRATO_CENTS, STRAIGHT_CENTS, VIBRATO_FRAMES, VIBRATO_HZ = 0.05, 0.2, 80, 30.0, 20, 8, (4.0, 8.0)


def ornament(events: DataFrame) -> DataFrame:
    """Adds kind: grace_note, glissando, vibrato, straight or other."""
    d = F.col("end") - F.col("start")
    wave = detrended(F.col("cents"))
    rate = zero_crossings(F.col("cents")) / (2.0 * d)
    vibrato = (F.col("n") >= VIBRATO_FRAMES) & (d > 0) & rate.between(*VIBRATO_HZ) & (percentile_of(F.transform(wave, F.abs), 0.95) >= VIBRATO_CENTS)
    glides = (d >= GLIDE_S) & (F.abs(F.col("last_cents") - F.col("first_cents")) >= GLIDE_CENTS)
    straight = F.col("high") - F.col("low") <= STRAIGHT_CENTS
    return events.withColumn("kind", F.when(d < GRACE_S, "grace_note").when(glides, "glissando").when(vibrato, "vibrato").when(straight, "straight").otherwise("other"))


def bigrams(events: DataFrame, key: str = "track") -> DataFrame:
    """Counts of steps from one degree to another."""
    w = Window.partitionBy(key).orderBy("island")
    step = events.withColumn("next", F.lead("note").over(w)).where("note <> next")
    return step.groupBy(key, F.concat_ws("->", "note", "next").alias("step")).agg(F.count(F.lit(1)).alias("n"))


def grid_fit(frames: DataFrame, pattern: list[int], key: str = "track", half: int = 20, least: int = 300) -> DataFrame:
    """Offset (cents) under which the pattern of degrees meets most of the pitch-class histogram, smoothed by a triangle.

    Null for tracks with fewer frames than the least. The first of equal offsets stands. Frames are counted into 1200 bins at
    most; a track's bins are one row, and the smoothing is done on such rows in Arrow batches, in whole numbers.
    """
    pc = F.least(F.floor(pitch.pitch_class_cents(F.col("hz"))).cast("int"), F.lit(1199))
    bins = frames.groupBy(key, pc.alias("bin")).agg(F.count(F.lit(1)).alias("h"))
    rows = bins.groupBy(key).agg(F.sum("h").alias("n_frames"), F.collect_list("bin").alias("bins"), F.collect_list("h").alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            row = np.repeat(np.arange(n), pc_.list_value_length(batch["bins"]).to_numpy(zero_copy_only=False))
            hist = np.zeros((n, 1200), np.int64)
            hist[row, batch["bins"].flatten().to_numpy()] = batch["counts"].flatten().to_numpy()
            smooth = sum((half + 1 - abs(k)) * np.roll(hist, k, axis=1) for k in range(-half, half + 1))
            offset = sum(np.roll(smooth, -p, axis=1) for p in pattern).argmax(axis=1) if n else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch[key], batch["n_frames"], pa.array(offset.astype(np.int32), mask=batch["n_frames"].to_numpy() < least)], names=[key, "n_frames", "offset"])

    return rows.mapInArrow(run, f"{key} {frames.schema[key].dataType.simpleString()}, n_frames long, offset int")


#: The pentatonic set, its modes, and the weights of root, fifth and other degrees.
BASE = (0, 2, 4, 7, 9)
MODES = [(0, 2, 4, 7, 9), (0, 2, 5, 7, 10), (0, 3, 5, 8, 10), (0, 2, 5, 7, 9), (0, 3, 5, 7, 10)]


def template(mode: tuple[int, ...]) -> list[float]:
    return [3.0 if k == 0 else 1.5 if k == 7 and 7 in mode else 1.0 if k in mode else 0.0 for k in range(12)]


PENTATONIC = [template(m) for m in MODES]
#: The Krumhansl and Kessler profiles of major and minor keys.
KEYS = [
    [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88],
    [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17],
]


def tonic(hist: DataFrame, key: str = "track", templates: list[list[float]] = PENTATONIC) -> DataFrame:
    """hist: key, pc, weight. Tonic and mode whose template correlates best; the first tonic, then mode, of equal ones.

    Twelve bins meet the fixed templates by an explode: a row for each bin, tonic and template of a key, none for each frame.
    """
    bins = F.array(*(F.sum(F.when(F.col("pc") == k, F.col("weight")).otherwise(0.0)) for k in range(12)))
    whole = hist.groupBy(key).agg(bins.alias("h"))
    fixed = F.array(*(F.struct(F.lit(t).alias("tonic"), F.lit(m).alias("mode"), F.array(*map(F.lit, x)).alias("w")) for t in range(12) for m, x in enumerate(templates)))
    rows = whole.select(key, "h", F.explode(fixed).alias("f")).select(key, "f.tonic", "f.mode", F.posexplode("f.w").alias("k", "w"), "h")
    r = rows.groupBy(key, "tonic", "mode").agg(F.corr(F.col("h")[F.pmod(F.col("k") + F.col("tonic"), F.lit(12)).cast("int")], F.col("w")).alias("r"))
    return r.where(F.col("r").isNotNull() & ~F.isnan("r")).groupBy(key).agg(F.max_by(F.struct("tonic", "mode", F.col("r").alias("score")), F.struct(F.round("r", 9), -F.col("tonic"), -F.col("mode"))).alias("b")).select(key, "b.*")


def beat_position(times: DataFrame, beats: DataFrame, key: str, id: str) -> DataFrame:
    """times: key, id, t; beats: key, b (at least two for a key). Fractional beat of each time: linear between beats, and on
    past the first and last with the step at that edge. Both are sorted together once by key; there is no range join."""
    w = Window.partitionBy(key).orderBy("b")
    steps = beats.select(key, "b", (F.row_number().over(w) - 1).alias("i"), (F.lead("b").over(w) - F.col("b")).alias("step"), (F.col("b") - F.lag("b").over(w)).alias("back"))
    steps = steps.withColumn("step", F.coalesce("step", "back"))
    edge = steps.where("i = 0").select(key, F.struct("b", F.lit(0).alias("i"), "step").alias("edge"))
    mark = F.struct("b", "i", "step")
    both = steps.select(key, F.col("b").alias("t"), F.lit(0).alias("kind"), mark.alias("m"), F.lit(None).cast(times.schema[id].dataType).alias(id)).unionByName(times.select(key, "t", F.lit(1).alias("kind"), F.lit(None).cast("struct<b:double,i:int,step:double>").alias("m"), id))
    last = F.last("m", True).over(Window.partitionBy(key).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("m", last).where("kind = 1").join(edge, key).withColumn("m", F.coalesce("m", "edge"))
    return found.select(key, id, (F.col("m.i") + (F.col("t") - F.col("m.b")) / F.col("m.step")).alias("beat"))


def tuning_offset(df: DataFrame, cents: Column, weight: Column, key: str = "track") -> DataFrame:
    """Circular mean of the deviation from twelve equal steps, in [-50, 50)."""
    a = F.radians(F.pmod(cents, F.lit(100.0)) * 3.6)
    return df.groupBy(key).agg((F.degrees(F.atan2(F.sum(weight * F.sin(a)), F.sum(weight * F.cos(a)))) / 3.6).alias("offset_cents"))


def running_median(df: DataFrame, value: str, key: str, order: list[str], width: int = 5) -> DataFrame:
    """Odd-width running median over what is not null; null centres stay null."""
    half = width // 2
    around = F.array_sort(F.collect_list(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(-half, half)))
    n = F.size(around)
    middle = (F.get(around, F.floor((n - 1) / 2).cast("int")) + F.get(around, F.floor(n / 2).cast("int"))) / 2
    return df.withColumn("smoothed", F.when(F.col(value).isNotNull(), middle))


def windows_labelled(points: DataFrame, spans: DataFrame, window: float, frames_per_window: int, voiced: float, modal: float, key: str = "track") -> DataFrame:
    """spans: key, duration. Tumbling windows of each track: 'unvoiced', the modal degree, or no row if neither is clear."""
    all_ = spans.select(key, F.explode(F.sequence(F.lit(0), F.greatest(F.floor(F.col("duration") / window) - 1, F.lit(-1)).cast("int"))).alias("w")).where("w >= 0")
    by = points.groupBy(key, F.floor(F.col("t") / window).cast("int").alias("w"), "note").agg(F.count(F.lit(1)).alias("c"))
    best = by.groupBy(key, "w").agg(F.sum("c").alias("n"), F.max("c").alias("top"), F.max_by("note", F.struct("c", "note")).alias("note"))
    joined = all_.join(best, [key, "w"], "left").withColumn("share", F.coalesce(F.col("n"), F.lit(0)) / frames_per_window)
    label = F.when(F.col("share") < voiced / 4, "unvoiced").when((F.col("share") >= voiced) & (F.col("top") / F.col("n") >= modal), F.col("note"))
    return joined.withColumn("label", label).where("label is not null").select(key, "w", "label")

"""Statistics over groups: summaries, rank tests, agreement of clusterings, classification figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def summary(df: DataFrame, value: str, by: list[str] | None = None, limit: float = 50.0, small: int = 1_000_000) -> DataFrame:
    """n, mean, median, population deviation, mean size, share beyond the limit (strictly).

    One aggregate where no group can have more than `small` values; else medians are selected as quantiles() does it.
    """
    x, by = F.col(value), by or []
    rest = [F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.avg(F.abs(x)).alias("mean_abs"), F.avg((F.abs(x) > limit).cast("int")).alias("beyond")]
    if df.where(x.isNotNull()).count() <= small:
        both = df.groupBy(*by).agg(*rest, F.median(x).alias("median"))
    else:
        both = beside(df.groupBy(*by).agg(*rest), quantiles(df, value, by, [0.5], small=small).withColumnRenamed("p50", "median"), by)
    return both.select(*by, "n", "mean", "median", "std", "mean_abs", "beyond")


def beside(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Figures of the same groups side by side; null is a group, too. Without groups both have one row."""
    if not by:
        return a.join(F.broadcast(b))
    other = b.select(*(F.col(c).alias(f"_{c}") for c in by), *(c for c in b.columns if c not in by))
    on = F.lit(True)
    for c in by:
        on = on & a[c].eqNullSafe(other[f"_{c}"])
    return a.join(other, on, "left").drop(*(f"_{c}" for c in by))


def summary_with_overall(df: DataFrame, value: str, by: str, limit: float = 50.0) -> DataFrame:
    """As summary, with a row for all (by: null)."""
    return summary(df, value, [by], limit).unionByName(summary(df, value, None, limit).withColumn(by, F.lit(None).cast("string")), allowMissingColumns=True)


def quantiles(df: DataFrame, value: str, by: list[str], points: list[float], bins: int = 256, small: int = 1_000_000) -> DataFrame:
    """by, p<percent>...: exact interpolated percentiles of each group, of any size; null values and NaN are left out.

    Groups of up to `small` rows are aggregated at once. In larger ones ranks are selected by refinement: rows are counted in
    equal ranges of value, in every task for itself; the range that holds a rank is cut again, until it holds one value. So no
    task ever holds the values of a large group, and each round shuffles counts only. A group with infinite values is
    aggregated at once.
    """
    x = F.col(value).cast("double")
    rows = df.select(*by, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    names = {q: f"p{round(100 * q)}" for q in points}
    size = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    wide = F.abs("_lo") + F.abs("_hi") < 1e308
    large = [r.asDict() for r in size.where((F.col("_n") > small) & wide).collect()]  # rows / small of them, at most
    direct = rows
    if large:
        spark = df.sparkSession
        keys = spark.createDataFrame([tuple(r[c] for c in by) + (True,) for r in large], T.StructType([*(df.schema[c] for c in by), T.StructField("_large", T.BooleanType())])) if by else None
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
        direct = rows.alias("a").join(keys.alias("b"), same, "left_anti") if by else rows.where(F.lit(False))
    done = direct.groupBy(*by).agg(F.percentile("_x", F.array(*map(F.lit, points))).alias("_p")).select(*by, *(F.col("_p")[k].alias(n) for k, n in enumerate(names.values())))
    if not by:
        done = done.where(F.lit(not large))
    if not large:
        return done
    ranks = []  # each: the group, the rank from 0 in what is left, its range
    for g, r in enumerate(large):
        for q in points:
            at = (r["_n"] - 1) * q
            ranks += [(g, q, int(at) + k, r["_lo"], r["_hi"]) for k in (0, 1) if int(at) + k < r["_n"]]
    found: dict[tuple[int, float, int], float] = {}
    todo = [(g, q, rank, rank, lo, hi) for g, q, rank, lo, hi in ranks]  # (.., rank in the group, rank in the range, range)
    kind = T.StructType([*(df.schema[c] for c in by), T.StructField("_g", T.IntegerType()), T.StructField("_lo", T.DoubleType()), T.StructField("_hi", T.DoubleType())])
    while todo:
        done_now = {(g, q, rank): lo for g, q, rank, _, lo, hi in todo if lo == hi}
        found |= done_now
        todo = [x for x in todo if x[:3] not in done_now]
        spans = sorted({(g, lo, hi) for g, _, _, _, lo, hi in todo})
        if not spans:
            break
        ranges = df.sparkSession.createDataFrame([tuple(large[g][c] for c in by) + (g, lo, hi) for g, lo, hi in spans], kind)
        on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by] + [F.col("_x").between(F.col("_lo"), F.col("_hi"))]
        cell = F.least(F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
        # a few ranges for each large group are sent; counts, the least and the largest value of a cell come back
        cells = rows.alias("a").join(F.broadcast(ranges.alias("b")), on).groupBy("_g", "_lo", "_hi", cell.alias("_c")).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high"))
        seen: dict[tuple[int, float, float], list] = {}
        for r in cells.orderBy("_g", "_lo", "_hi", "_c").collect():
            seen.setdefault((r["_g"], r["_lo"], r["_hi"]), []).append((r["n"], r["low"], r["high"]))
        new = []
        for g, q, rank, left, lo, hi in todo:
            for n, low, high in seen[g, lo, hi]:
                if left < n:
                    new.append((g, q, rank, left, low, high))
                    break
                left -= n
        todo = new
    out = []
    for g, r in enumerate(large):
        values = []
        for q in points:
            at = (r["_n"] - 1) * q
            a = found[g, q, int(at)]
            b = found.get((g, q, int(at) + 1), a)
            values.append(a + (b - a) * (at - int(at)))
        out.append(tuple(r[c] for c in by) + tuple(values))
    return done.unionByName(df.sparkSession.createDataFrame(out, T.StructType([*(df.schema[c] for c in by), *(T.StructField(n, T.DoubleType()) for n in names.values())])))


def supported(value: Column, n: Column, least: int) -> Column:
    """The value only where enough rows stand behind it; the group stays."""
    return F.when(n >= least, value)


def mann_whitney(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """One row: n_a, n_b, u (of a, ties by average rank), z (normal approximation with tie and continuity correction), p
    (two-sided; null with fewer than three values on a side).

    Ranks come from the counts of distinct values. These are dealt to ranges; a window runs within a range, to which the
    totals of the ranges before it are added, so that no task walks through all values.
    """
    both = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    cuts = sorted(set(both.approxQuantile(value, [k / 64 for k in range(1, 64)], 0.01)))
    part = F.aggregate(F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>"), F.lit(0), lambda n, c: n + (F.col(value) > c).cast("int"))
    by = both.withColumn("part", part).groupBy(value, "part").agg(F.count_if(F.col(group) == a).alias("na"), F.count_if(F.col(group) == b).alias("nb")).withColumn("t", F.col("na") + F.col("nb"))
    totals = {r.part: r.n for r in by.groupBy("part").agg(F.sum("t").alias("n")).collect()}  # 64 rows at most
    first = {p: sum(n for q, n in totals.items() if q < p) for p in totals}
    before = F.create_map(*(F.lit(x) for pair in first.items() for x in pair))[F.col("part")] if first else F.lit(0)
    below = F.coalesce(F.sum("t").over(Window.partitionBy("part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = by.withColumn("below", below).withColumn("rank", before + F.col("below") + (F.col("t") + 1) / 2.0)
    s = ranked.agg(F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"), F.sum(F.col("rank") * F.col("na")).alias("r"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n_a") + F.col("n_b")
    u = F.col("r") - F.col("n_a") * (F.col("n_a") + 1) / 2.0
    sd = F.sqrt(F.col("n_a") * F.col("n_b") / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.greatest(F.lit(0.0), (F.abs(u - F.col("n_a") * F.col("n_b") / 2.0) - 0.5) / sd)
    return s.select("n_a", "n_b", u.alias("u"), z.alias("z"), F.when(F.least("n_a", "n_b") >= 3, erfc(z / F.sqrt(F.lit(2.0)))).alias("p"))


#: The error function's rational approximation (Abramowitz and Stegun 7.1.26, error below 1.5e-7).
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc(x: Column) -> Column:
    """Of x >= 0."""
    t = 1 / (1 + ERF_P * x)
    total = F.lit(0.0)
    for a in reversed(ERF_A):
        total = (total + a) * t
    return total * F.exp(-x * x)


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, ari. From the contingency counts; all sums are combinable."""
    pairs = lambda n: n * (n - 1) / 2.0
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    one = cells.agg(F.sum(pairs(F.col("n"))).alias("index"), F.sum("n").alias("total"))
    side = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias(name))
    x = one.join(F.broadcast(side(a, "sa"))).join(F.broadcast(side(b, "sb")))  # one row each
    expected = F.col("sa") * F.col("sb") / pairs(F.col("total"))
    return x.select(F.col("total").alias("n"), ((F.col("index") - expected) / ((F.col("sa") + F.col("sb")) / 2 - expected)).alias("ari"))


def confusion(df: DataFrame, truth: str, predicted: str, classes: list) -> DataFrame:
    """Dense: a row for each pair of classes."""
    spark = df.sparkSession
    kind = df.schema[truth].dataType.simpleString()
    grid = spark.createDataFrame([(a, b) for a in classes for b in classes], f"{truth} {kind}, {predicted} {kind}")
    return grid.join(df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n")), [truth, predicted], "left").fillna(0, ["n"])


def class_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class: support, precision, recall, f1; null where nothing was seen."""
    side = lambda c, is_t: df.select(F.col(c).alias("label"), F.lit(int(is_t)).alias("t"), F.lit(int(not is_t)).alias("p"), (F.col(truth) == F.col(predicted)).cast("int").alias("hit"))
    s = side(truth, True).unionByName(side(predicted, False)).groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum(F.col("hit") * F.col("t")).alias("tp"))
    precision, recall = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")), F.when(F.col("support") > 0, F.col("tp") / F.col("support"))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).when((F.col("support") > 0) & (F.col("predicted") > 0), F.lit(0.0))
    return s.select("label", "support", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """One row: the upper of the two middle values. A sort finds it; no task holds all values."""
    n = df.where(F.col(value).isNotNull()).count()
    return df.where(F.col(value).isNotNull()).select(value).orderBy(value).offset(n // 2).limit(1)


def modal_share(df: DataFrame, key: str, value: str) -> DataFrame:
    c = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy(key).agg(F.max_by(value, F.struct("c", value)).alias("mode"), (F.max("c") / F.sum("c")).alias("share"))

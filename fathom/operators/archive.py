"""Filters, joins, paging and writes over archive documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats


def live(df: DataFrame, deleted: str = "deleted_at") -> DataFrame:
    return df.where(F.col(deleted).isNull())


def facets(df: DataFrame, **values) -> DataFrame:
    """Equality on the columns whose value is given."""
    return reduce(lambda d, x: d.where(F.col(x[0]) == x[1]), ((k, v) for k, v in values.items() if v is not None), df)


def contains_any(df: DataFrame, query: str | None, columns: list[str]) -> DataFrame:
    """Rows where any column contains the query, in any case; a blank query keeps all."""
    if not query or not query.strip():
        return df
    q = query.strip().lower()
    return df.where(reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(F.col(c)), F.lit(q)), F.lit(False)) for c in columns)))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page with total and has_more. One window-free count joins the page; the sort keeps only the rows needed."""
    start = (number - 1) * size
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(*order).offset(start).limit(size)
    return rows.join(F.broadcast(total)).withColumn("has_more", F.lit(start + size) < F.col("total"))  # one row is sent


def top_per_key(df: DataFrame, key: str | list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def hydrate(ids: DataFrame, rows: DataFrame, key: str, status: str | None = "published", limit: int | None = None) -> DataFrame:
    """Rows for ids (key, pos) in their order; those that are gone or not in the status drop out before the limit."""
    rows = rows if status is None else rows.where(F.col("status") == status)
    out = ids.join(rows, key).orderBy("pos")
    return out if limit is None else out.limit(limit)


def overfetch(ids: DataFrame, rows: DataFrame, key: str, limit: int, factor: int = 3) -> DataFrame:
    """As hydrate, but only the first factor * limit ids are looked at."""
    return hydrate(ids.where(F.col("pos") < factor * limit), rows, key, limit=limit)


def counts_joined(df: DataFrame, items: DataFrame, key: str, name: str) -> DataFrame:
    """Number of items for each row, 0 where there are none. Counted before the join."""
    return df.join(items.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").fillna(0, [name])


def override(df: DataFrame, better: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of better stand where they are not blank; source tells whether a row matched."""
    b = better.select(key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_hit"))
    out = df.join(b, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.when(F.trim(F.col(f"_{c}")) != "", F.col(f"_{c}")), F.col(c)))
    return out.withColumn("source", F.when(F.col("_hit"), "catalog").otherwise("filename")).drop("_hit", *(f"_{c}" for c in columns))


def upsert(rows: DataFrame, changes: DataFrame, key: str, order: str, keep_first: list[str]) -> DataFrame:
    """The last change of each key over the row that was there; columns in keep_first stay as first written."""
    both = rows.unionByName(changes)
    others = [c for c in both.columns if c not in (key, *keep_first)]
    return both.groupBy(key).agg(*(F.min_by(c, order).alias(c) for c in keep_first), *(F.max_by(c, order).alias(c) for c in others))


def patch(changes: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The last value that is not null of each column of each key."""
    return changes.groupBy(key).agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))


def not_yet(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key).distinct(), key, "left_anti")


def first_seen_flags(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """duplicate_of: the name of the first row of the group, for all rows but that one."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("duplicate_of", F.when(F.row_number().over(w) > 1, F.first(name).over(w)))


def carry_forward(df: DataFrame, is_header: Column, value: Column, key: list[str], order: list[str], name: str) -> DataFrame:
    """The value of the last header row so far; a header without a value resets it."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(F.when(is_header, F.struct(value.alias("v"))), ignorenulls=True).over(w)["v"])


def first_write(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row that was written first; later ones do not change it."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_first")).select(key, "_first.*")


def page_after(df: DataFrame, newest: str, key: str, last, size: int) -> DataFrame:
    """The next rows, newest first and then by key, after the last row of the page before (None: the first page). A
    condition on the keys; rows before it are not sorted again."""
    rows = df
    if last is not None:
        rows = df.where((F.col(newest) < F.lit(last[newest])) | ((F.col(newest) == F.lit(last[newest])) & (F.col(key) > F.lit(last[key]))))
    return rows.orderBy(F.desc(newest), key).limit(size)


def next_try(attempts: Column, permanent: Column, most: int, base: int) -> Column:
    """struct(action, wait in seconds) after a failed try: permanent errors are rejected, the rest is tried again after a
    pause that doubles, until there were `most` tries."""
    again = ~permanent & (attempts < most)
    action = F.when(permanent, "rejected").when(again, "retry").otherwise("failed")
    return F.struct(action.alias("action"), F.when(again, F.lit(base) * F.pow(F.lit(2), attempts).cast("long")).alias("wait"))


def compared(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, left, right, delta (left less right), side (both, left, right): all rows that either run has; null keys meet, too.
    delta is null where a side is missing or has no value."""
    a = left.select(*keys, F.col(value).alias("left"), F.lit(True).alias("_a"))
    b = right.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(value).alias("right"), F.lit(True).alias("_b"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    side = F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise("both")
    own = [F.when(F.col("_a").isNull(), F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    return a.join(b, on, "full_outer").select(*own, "left", "right", (F.col("left") - F.col("right")).alias("delta"), side.alias("side"))


def compared_summary(pairs: DataFrame) -> DataFrame:
    """One row: n_both, only_left, only_right, median_delta (of the sizes of the deltas)."""
    n = pairs.agg(*(F.count_if(F.col("side") == s).alias(c) for s, c in (("both", "n_both"), ("left", "only_left"), ("right", "only_right"))))
    return stats.beside(n, stats.quantiles(pairs.select(F.abs("delta").alias("d")), "d", [], [0.5]).withColumnRenamed("p50", "median_delta"), [])


def joined_with_misses(rows: DataFrame, lookup: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with what the lookup says, key and n of the rows that it has nothing for; null keys are among these)."""
    missed = rows.join(lookup.select(key), key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(lookup, key), missed

"""Vector expressions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def normalised(v: Column, digits: int | None = None) -> Column:
    n = norm(v)
    return F.transform(v, lambda x: F.bround(x.cast("double") / n, digits) if digits is not None else x.cast("double") / n)


def valid(v: Column, size: int) -> Column:
    """Of the size, without null or non-finite numbers, not all zero."""
    return F.coalesce((F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def percentile(values: Column, share: float) -> Column:
    """The percentile of an array, between its two nearest elements in proportion; null for an empty one."""
    sorted_ = F.array_sort(F.transform(values, lambda x: x.cast("double")))
    at = (F.size(values) - 1) * F.lit(share)
    low = F.get(sorted_, F.floor(at).cast("int"))
    return low + (F.get(sorted_, F.ceil(at).cast("int")) - low) * (at - F.floor(at))

"""Column functions on arrays of doubles, all built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside the lambdas of ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def total(x: Column) -> Column:
    """Sum in order; nulls count as 0."""
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + F.coalesce(v.cast("double"), F.lit(0.0)))


def mean(x: Column) -> Column:
    return F.when(F.size(x) > 0, total(x) / F.size(x))


def quantile(x: Column, q: float) -> Column:
    """Linear interpolation between order statistics; null for an empty array."""

    def of(s: Column) -> Column:
        at = (F.size(s) - 1) * F.lit(float(q))
        low = F.floor(at).cast("int")
        a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
        return F.when(F.size(s) > 0, a + (b - a) * (at - low))

    return let(F.array_sort(x), of)


def median(x: Column) -> Column:
    return quantile(x, 0.5)


def deviations(x: Column, centre: Column) -> Column:
    return let(centre, lambda c: F.transform(x, lambda v: F.abs(v - c)))


def mad(x: Column) -> Column:
    """Median absolute deviation from the median."""
    return median(deviations(x, median(x)))


def dot(a: Column, b: Column) -> Column:
    """Scalar product in order, both as double."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def correlation(a: str, b: str) -> Column:
    """Pearson correlation as an aggregate; null instead of an error where a side doesn't vary."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 0, F.try_divide(F.covar_pop(a, b), spread))

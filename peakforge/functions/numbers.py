"""Column functions for numbers written as text and for running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
BLANKS = " \t\r"


def number(text: Column, comma: Column | None = None) -> Column:
    """A decimal number with optional exponent as double, else null; where ``comma`` holds, one decimal comma counts as a point."""
    text = F.trim(text, F.lit(BLANKS))
    if comma is not None:
        text = F.when(comma & ~F.contains(text, F.lit(".")), F.regexp_replace(text, "^([^,]*),([^,]*)$", "$1.$2")).otherwise(text)
    return F.when(text.rlike(NUMBER), text.cast("double"))


def finite(value: Column) -> Column:
    """False for null, NaN and infinities."""
    return F.coalesce((F.abs(value) < F.lit(float("inf"))), F.lit(False))


def running_total(df: DataFrame, value: str, bucket: Column, order: list[str], within: list[str] = (), out: str = "before") -> DataFrame:
    """Adds ``out``: the exact sum of ``value`` over all earlier rows of the same ``within`` group.

    Two levels keep every task bounded: rows are summed inside ``bucket`` (a column expression that rises with the
    order and holds a bounded number of rows), and only the totals of the buckets, one row each, are summed in one
    window. Null values count as 0; ties of ``order`` must not occur.
    """
    within = list(within)
    df = df.withColumn("_b", bucket)
    inner = Window.partitionBy(*within, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*within).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    v = F.coalesce(F.col(value), F.lit(0))
    totals = df.groupBy(*within, "_b").agg(F.sum(v).alias("_t"))
    totals = totals.select(*within, "_b", F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_o"))
    inside = df.withColumn("_i", F.coalesce(F.sum(v).over(inner), F.lit(0)))
    cond = [inside[c].eqNullSafe(totals[c]) for c in [*within, "_b"]]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    return inside.join(totals, on).select(*[inside[c] for c in df.columns if c != "_b"], (inside["_i"] + totals["_o"]).alias(out))


def with_ranges(df: DataFrame, value: str, within: list[str] = (), out: str = "_r", ranges: int = 64) -> DataFrame:
    """Adds ``out``, the number of the value range a row lies in: ``ranges`` ranges of about as many rows each per group, rising with the value.

    The limits are approximate quantiles, one row per group, so no task sorts a whole group.
    """
    limits = df.groupBy(*within).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 1000).alias("_l"))
    if within:
        renamed = limits.select(*[F.col(c).alias(f"_{c}") for c in within], "_l")
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in within]
        joined = df.join(renamed, on[0] if len(on) == 1 else on[0] & on[1] if len(on) == 2 else on[0] & on[1] & on[2])
    else:
        joined = df.crossJoin(limits)  # one row
    return joined.withColumn(out, F.aggregate("_l", F.lit(0), lambda n, v: n + (v < F.col(value)).cast("int"))).drop("_l", *[f"_{c}" for c in within])

"""Frames that hold exactly what a plot shows, for any plotting library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Categories in their order, with the names they are shown by.
CATEGORIES = ["S", "I", "R"]
SHOWN = {"S": "Susceptible", "I": "Intermediate", "R": "Resistant"}


def label_place(label: Column) -> Column:
    """Sort key: S, I, R, then numbers by value, then other labels by name; nulls last."""
    text = label.cast("string")
    number = text.try_cast("double")
    group = F.when(text.isin(CATEGORIES), 0).when(number.isNotNull(), 1).when(text.isNotNull(), 2).otherwise(3)
    return F.struct(group.alias("group"), F.when(group == 0, F.array_position(F.array(*map(F.lit, CATEGORIES)), text).cast("double")).otherwise(number).alias("number"), text.alias("label"))


def ordered_labels(rows: DataFrame, label: str) -> DataFrame:
    """(label, shown, place, n): each label once in the order of a legend."""
    n = rows.groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    shown = F.coalesce(F.create_map(*[F.lit(v) for kv in SHOWN.items() for v in kv])[F.coalesce("label", F.lit(""))], "label")
    return n.select("label", shown.alias("shown"), F.row_number().over(Window.orderBy(label_place(F.col("label")))).cast("bigint").alias("place"), "n")


def spectrum_lines(spectra: DataFrame, mz: str = "mz", x: str = "intensity", key: str = "spectrum_no") -> DataFrame:
    """(key, pos, mz, intensity, share): the line of each spectrum, with intensity over its maximum (0 where there is none)."""
    top = F.array_max(x).cast("double")
    p = spectra.where(F.col(mz).isNotNull() & F.col(x).isNotNull()).select(key, top.alias("_top"), F.posexplode(F.arrays_zip(F.col(mz).alias("mz"), F.col(x).alias("x"))).alias("pos", "p"))
    return p.select(key, "pos", F.col("p.mz").alias("mz"), F.col("p.x").cast("double").alias("intensity"), F.when(F.col("_top") > 0, F.col("p.x") / F.col("_top")).otherwise(0.0).alias("share"))


def peak_overlay(lines: DataFrame, peaks: DataFrame, key: str = "spectrum_no") -> DataFrame:
    """``lines`` (key, pos, ...) with ``is_peak``: whether ``peaks`` (key, pos) has the place."""
    marks = peaks.select(key, "pos", F.lit(True).alias("is_peak")).distinct()
    return lines.join(marks, [key, "pos"], "left").withColumn("is_peak", F.coalesce("is_peak", F.lit(False)))


def before_after(before: DataFrame, after: DataFrame, key: str = "spectrum_no") -> DataFrame:
    """(key, bin_index, stage, intensity): both states of binned spectra, one under the other."""
    a, b = (df.select(key, "bin_index", F.lit(s).alias("stage"), "intensity") for df, s in ((before, "before"), (after, "after")))
    return a.union(b)


def pseudogel(matrix: DataFrame, label: str, regions: list[tuple[float, float]], start: float, width: float, key: str = "spectrum_no") -> DataFrame:
    """(label, place, key, region, bin_index, shade): gel lanes by label, brightest first, of the given m/z regions.

    ``matrix`` has key, bin_index, intensity and the label. The lane's place counts within its label; between two regions stands one bin
    without a shade (null), so that a gap is seen. Shade is log1p of the intensity.
    """
    mean = matrix.groupBy(key, label).agg(F.avg("intensity").alias("m"))
    lanes = mean.select(key, label, F.row_number().over(Window.partitionBy(label).orderBy(F.desc(F.round("m", 9)), key)).cast("bigint").alias("place"))
    mz = F.col("bin_index") * F.lit(width) + F.lit(start)
    held = [matrix.where(mz.between(low, high)).select(key, F.lit(i).alias("region"), "bin_index", F.log1p("intensity").alias("shade")) for i, (low, high) in enumerate(regions)]
    gaps = [lanes.select(key, F.lit(i).alias("region"), F.lit(None).cast("int").alias("bin_index"), F.lit(None).cast("double").alias("shade")) for i in range(len(regions) - 1)]
    parts = held[0]
    for p in held[1:] + gaps:
        parts = parts.union(p)
    return lanes.join(parts, key).select(label, "place", key, "region", "bin_index", "shade")


def embedding(matrix: DataFrame, k: int = 2, key: str = "spectrum_no") -> DataFrame:
    """(key, pc1, pc2, ...): spectra in the plane of the principal axes of their standardised bins."""
    from peakforge.operators.drift import principal_axes

    mean, std, load = principal_axes(matrix, k, key)
    table = [(i, float(mean[i]), float(std[i]) or 1.0, [float(v) for v in load[i]]) for i in range(len(mean))]
    axes = matrix.sparkSession.createDataFrame(table, "bin_index int, _m double, _s double, _l array<double>")
    z = (F.col("intensity") - F.col("_m")) / F.col("_s")
    return matrix.join(axes, "bin_index").groupBy(key).agg(*[F.sum(z * F.get("_l", F.lit(i))).alias(f"pc{i + 1}") for i in range(k)])

"""Merging replicate spectra and handling duplicate records."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakforge.functions.arrays import correlation

STRATEGIES = ("first", "last", "drop", "keep_all", "average")


def merge(points: DataFrame, group: str, axis: str = "bin_index", value: str = "intensity", how: str = "mean", weight: str | None = None) -> DataFrame:
    """(group, axis, value) of spectra on one common axis: mean, weighted mean or exact median per axis point."""
    if how == "mean":
        agg = F.avg(value)
    elif how == "weighted":
        agg = F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))
    elif how == "median":
        agg = F.median(value)
    else:
        raise ValueError(f"unknown way to merge: {how}")
    return points.groupBy(group, axis).agg(agg.alias(value))


def merge_grids(spectra: DataFrame, group: str) -> DataFrame:
    """(group, mz, intensity) arrays: mean of spectra with different axes on the union of their points, interpolated linearly.

    Beyond the ends of a spectrum its end value holds. Null spectra are left out. One group must fit into a task: replicates of one isolate.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        axes = [np.asarray(m, float) for m in f["mz"]]
        grid = np.unique(np.concatenate(axes))
        mean = np.mean([np.interp(grid, m, np.asarray(x, float)) for m, x in zip(axes, f["intensity"])], axis=0)
        return pd.DataFrame({group: [f[group].iloc[0]], "mz": [grid], "intensity": [mean]})

    kind = dict(spectra.dtypes)[group]
    return spectra.select(group, "mz", "intensity").where("mz is not null and intensity is not null and size(mz) > 0").groupBy(group).applyInPandas(run, f"{group} {kind}, mz array<double>, intensity array<double>")


def merge_overlap(spectra: DataFrame, group: str) -> DataFrame:
    """(group, mz, intensity) arrays: mean of the spectra of a group on the range they share.

    Steps are the smallest of the spectra's median steps. A lone spectrum stays as it is; spectra that share no range are an error. Null and
    empty spectra are left out. One group must fit into a task: replicates of one isolate.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        axes, values = ([np.asarray(v, float) for v in f[c]] for c in ("mz", "intensity"))
        if len(axes) == 1:
            return pd.DataFrame({group: [f[group].iloc[0]], "mz": axes, "intensity": values})
        low, high = max(a.min() for a in axes), min(a.max() for a in axes)
        if low >= high:
            raise ValueError(f"replicates of {f[group].iloc[0]} share no range")
        step = min((float(np.median(np.diff(a))) for a in axes if len(a) > 1), default=0.0)
        if step <= 0:
            raise ValueError(f"replicates of {f[group].iloc[0]} have no steps")
        grid = np.arange(low, high + step / 2, step)
        return pd.DataFrame({group: [f[group].iloc[0]], "mz": [grid], "intensity": [np.mean([np.interp(grid, a, v) for a, v in zip(axes, values)], axis=0)]})

    kind = dict(spectra.dtypes)[group]
    return spectra.select(group, "mz", "intensity").where("mz is not null and intensity is not null and size(mz) > 0").groupBy(group).applyInPandas(run, f"{group} {kind}, mz array<double>, intensity array<double>")


def outlier_replicates(points: DataFrame, group: str, key: str, axis: str = "bin_index", value: str = "intensity", threshold: float = 3.0) -> DataFrame:
    """(group, key, correlation, keep): spectra whose correlation with the group's median spectrum is not far below the usual.

    The limit is the median correlation less ``threshold`` scaled MADs, at least -1; without spread all are kept, and so are groups of fewer than three.
    """
    centre = points.groupBy(group, axis).agg(F.median(value).alias("_c"))
    corr = points.join(centre, [group, axis]).groupBy(group, key).agg(F.coalesce(correlation(value, "_c"), F.lit(0.0)).alias("correlation"))
    mid = corr.groupBy(group).agg(F.median("correlation").alias("_m"), F.count(F.lit(1)).alias("_n"))
    dev = corr.join(mid, group).groupBy(group, "_m", "_n").agg(F.median(F.abs(F.col("correlation") - F.col("_m"))).alias("_d"))
    limit = F.greatest(F.col("_m") - threshold * 1.4826 * F.col("_d"), F.lit(-1.0))
    keep = (F.col("_d") == 0) | (F.col("_n") < 3) | (F.col("correlation") >= limit)
    return corr.join(dev, group).select(group, key, "correlation", keep.alias("keep"))


def isolate_key(id_: Column, pattern: str = r"_MALDI\d+$") -> Column:
    """The id without its mark of replicate."""
    return F.regexp_replace(id_, pattern, "")


def resolve_duplicates(records: DataFrame, id_: str, order: list[str], strategy: str, suffix: str | None = None) -> DataFrame:
    """Records with duplicate ids resolved; ``order`` is the total order in which they stand.

    first and last keep one record, drop keeps only ids without duplicate, average keeps all and adds ``_original_id``.
    keep_all numbers the ids (``_rep1``, ... or the value of ``suffix``), of all records once any id occurs twice; equal new
    ids keep their first record. Null ids count as one id.
    """
    w = Window.partitionBy(id_)
    if strategy in ("first", "last"):
        asc = [F.asc(c) if strategy == "first" else F.desc(c) for c in order]
        return records.withColumn("_r", F.row_number().over(w.orderBy(*asc))).where("_r = 1").drop("_r")
    if strategy == "drop":
        return records.withColumn("_n", F.count(F.lit(1)).over(w)).where("_n = 1").drop("_n")
    if strategy == "average":
        return records.withColumn("_original_id", F.col(id_))
    if strategy != "keep_all":
        raise ValueError(f"unknown strategy {strategy}; known: {', '.join(STRATEGIES)}")
    if not records.groupBy(id_).count().where("count > 1").limit(1).count():
        return records
    mark = F.concat(F.lit("_rep"), F.row_number().over(w.orderBy(*order))) if suffix is None else F.concat(F.lit("_"), F.col(suffix).cast("string"))
    named = records.withColumn(id_, F.concat(F.col(id_).cast("string"), mark))
    return named.withColumn("_r", F.row_number().over(Window.partitionBy(id_).orderBy(*order))).where("_r = 1").drop("_r")

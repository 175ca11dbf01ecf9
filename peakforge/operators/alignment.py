"""Alignment of spectra to a reference."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakforge.functions import kernels
from peakforge.functions.arrays import correlation, let, median


METHODS = ("shift", "linear", "piecewise", "quadratic", "cubic", "lowess", "dtw")
#: Peaks a reference should have at least.
MIN_REFERENCE_PEAKS = 5


def reference_row(spectra: DataFrame, x: str, place: int, key: str = "spectrum_no") -> np.ndarray:
    """The spectrum at a 0-based place in order of the key as reference; a place outside is an error."""
    rows = spectra.select(key, x).orderBy(key).offset(place).limit(1).collect() if place >= 0 else []
    if not rows:
        raise ValueError(f"there is no spectrum {place}")
    return np.asarray(rows[0][x], float)


def median_reference(matrix: DataFrame, axis: str = "bin_index", value: str = "intensity") -> DataFrame:
    """(axis, reference): exact median spectrum; one shuffle on the axis."""
    return matrix.groupBy(axis).agg(F.median(value).alias("reference"))


def nearest_reference(value: Column, reference: list[float]) -> Column:
    """The nearest of the ascending reference values; halfway goes to the upper one."""
    if not reference:
        raise ValueError("no reference peaks")
    table = F.array(*[F.lit(float(v)) for v in reference])
    better = lambda best, r: F.when(F.abs(r - value) <= F.abs(best - value), r).otherwise(best)
    return F.aggregate(table, F.lit(float(reference[0])), better)


def peak_shift(peaks: Column, reference: list[float]) -> Column:
    """Median distance of an array of peaks to their nearest reference peaks, 0 without peaks."""
    return F.coalesce(median(F.transform(peaks, lambda p: nearest_reference(p, reference) - p)), F.lit(0.0))


def shift_binned(x: Column, shift: Column, most: int) -> Column:
    """Array moved by the rounded shift (half to even, within +-most) to the right, filled with zeros."""

    def move(s: Column) -> Column:
        zeros = F.transform(F.sequence(F.lit(1), F.greatest(F.abs(s), F.lit(1))), lambda i: F.lit(0.0))
        return (
            F.when(s > 0, F.concat(zeros, F.slice(x, 1, F.greatest(F.size(x) - s, F.lit(0)))))
            .when(s < 0, F.concat(F.slice(x, 1 - s, F.greatest(F.size(x) + s, F.lit(0))), zeros))
            .otherwise(x)
        )

    return let(F.greatest(F.least(F.bround(shift).cast("int"), F.lit(most)), F.lit(-most)), move)


def line_fit(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, slope, intercept, n_used): least squares of b on a per key, refitted once without residuals beyond 3 scaled MADs; slope 0 where a doesn't vary."""
    slope = F.coalesce(F.try_divide(F.covar_pop(a, b), F.var_pop(a)), F.lit(0.0))
    cut = F.avg(b) - slope * F.avg(a)
    fit = pairs.groupBy(key).agg(slope.alias("s"), cut.alias("i"))
    res = pairs.join(fit, key).withColumn("r", F.col(b) - F.col("s") * F.col(a) - F.col("i"))
    mid = res.groupBy(key).agg(F.median("r").alias("m"))
    dev = res.join(mid, key).withColumn("d", F.abs(F.col("r") - F.col("m")))
    limit = dev.groupBy(key).agg((3 * 1.4826 * F.median("d")).alias("limit"))
    kept = dev.join(limit, key).where(F.round("d", 9) <= F.round("limit", 9))
    return kept.groupBy(key).agg(slope.alias("slope"), cut.alias("intercept"), F.count(F.lit(1)).alias("n_used"))


def alignment_quality(before: DataFrame, after: DataFrame, reference: DataFrame, key: str = "spectrum_no", axis: str = "bin_index", value: str = "intensity") -> DataFrame:
    """(key, corr_before, corr_after, rmse_before, rmse_after) against the reference; an undefined correlation is 0."""

    def one(df: DataFrame, name: str) -> DataFrame:
        j = df.join(F.broadcast(reference), axis)
        return j.groupBy(key).agg(F.coalesce(correlation(value, "reference"), F.lit(0.0)).alias(f"corr_{name}"), F.sqrt(F.avg((F.col(value) - F.col("reference")) ** 2)).alias(f"rmse_{name}"))

    return one(before, "before").join(one(after, "after"), key)


def warped(spectra: DataFrame, x: str, reference: np.ndarray, method: str, prominence: float = 1e-5, key: str = "spectrum_no", **options) -> DataFrame:
    """(key, x): binned spectra aligned in bin space; spectra are worked on in Arrow batches, the reference is a bounded array.

    A spectrum of another length than the reference is an error, a null one stays null. Fewer than MIN_REFERENCE_PEAKS peaks of the reference give a warning.
    """
    ref = np.asarray(reference, float)
    ref_peaks = kernels.local_peaks(ref, prominence=prominence).astype(float)
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; known: {', '.join(METHODS)}")
    if len(ref_peaks) < MIN_REFERENCE_PEAKS:
        warnings.warn(f"the reference has only {len(ref_peaks)} peaks", stacklevel=2)

    def one(v: np.ndarray, axis: np.ndarray) -> np.ndarray:
        if len(v) != len(ref):
            raise ValueError(f"a spectrum has {len(v)} points, the reference {len(ref)}")
        return kernels.align(method, axis, v, kernels.local_peaks(v, prominence=prominence).astype(float), ref_peaks, ref, **options)

    def run(frames):
        axis = np.arange(len(ref), dtype=float)
        for f in frames:
            yield pd.DataFrame({key: f[key], x: [None if v is None else one(np.asarray(v, float), axis) for v in f[x]]})

    return spectra.select(key, x).mapInPandas(run, f"{key} bigint, {x} array<double>")


def aligned_peaks(sets: DataFrame, reference: list[float], method: str = "shift", key: str = "spectrum_no", **options) -> DataFrame:
    """(key, mz, intensity): peak sets whose m/z are moved towards the reference peaks; dtw isn't defined for peaks."""
    if method not in METHODS or method == "dtw":
        raise ValueError("dtw needs whole spectra" if method == "dtw" else f"unknown method {method}")
    ref = np.sort(np.asarray(reference, float))

    def run(frames):
        for f in frames:
            out = []
            for m in f["mz"]:
                m = np.asarray([] if m is None else m, float)
                if not len(m) or not len(ref):
                    out.append(m)
                    continue
                target = ref[kernels.nearest(m, ref)]
                if method == "linear" and len(m) > 1:
                    slope, cut = kernels.robust_line(m, target)
                    out.append(slope * m + cut)
                elif method == "lowess" and len(m) > 2:
                    out.append(m + kernels.lowess(m, target - m, options.get("share", 0.3), options.get("rounds", 3)))
                elif method in ("quadratic", "cubic") and len(m) > {"quadratic": 2, "cubic": 3}[method]:
                    out.append(np.polyval(np.polyfit(m, target, {"quadratic": 2, "cubic": 3}[method]), m))
                elif method == "piecewise" and len(m) > 1:
                    out.append(m + kernels.piecewise_offsets(m, target, m, options.get("segments", 5), options.get("sigma", 2.0)))
                else:
                    out.append(m + kernels.shift_of(m, ref, options.get("most", 50.0)))
            yield pd.DataFrame({key: f[key], "mz": out, "intensity": f["intensity"]})

    return sets.select(key, "mz", "intensity").mapInPandas(run, f"{key} bigint, mz array<double>, intensity array<double>")

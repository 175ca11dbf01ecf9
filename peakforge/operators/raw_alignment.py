"""Alignment of raw spectra, each on an m/z axis of its own: a common reference, the move to it, binning, and how much it helped.

Spectra are rows (key, mz, intensity) with ascending m/z. Spectra with null, empty or unequal arrays are left out.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.functions import kernels
from peakforge.functions.arrays import correlation
from peakforge.operators.alignment import METHODS, MIN_REFERENCE_PEAKS


@dataclass(frozen=True)
class Reference:
    """A reference spectrum on a regular axis and its peaks in m/z."""

    axis: np.ndarray
    signal: np.ndarray
    peaks: np.ndarray


def usable(spectra: DataFrame, key: str) -> DataFrame:
    return spectra.select(key, "mz", "intensity").where(F.col(key).isNotNull() & (F.size("mz") > 0) & (F.size("mz") == F.size("intensity")))


def common_axis(spectra: DataFrame, step: float = 0.5, key: str = "spectrum_no") -> np.ndarray:
    """The range all spectra share, in steps; it is an error if they share none."""
    low, high = usable(spectra, key).agg(F.max(F.array_min("mz")), F.min(F.array_max("mz"))).first()
    if step <= 0 or low is None or low >= high:
        raise ValueError("the spectra have no range in common" if step > 0 else "the step must be positive")
    return low + step * np.arange(int(np.floor((high - low) / step + 1e-9)) + 1)


def on_axis(spectra: DataFrame, axis: np.ndarray, key: str = "spectrum_no") -> DataFrame:
    """(key, x): intensities interpolated at the axis, 0 outside a spectrum's own range."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({key: f[key], "x": [np.interp(axis, np.asarray(m, float), np.asarray(v, float), left=0.0, right=0.0) for m, v in zip(f["mz"], f["intensity"])]})

    rows = usable(spectra, key)
    return rows.mapInPandas(run, f"{key} {rows.schema[0].dataType.simpleString()}, x array<double>")


def reference_points(spectra: DataFrame, axis: np.ndarray, key: str = "spectrum_no") -> DataFrame:
    """(pos, mz, reference): the median of all spectra at every place of the axis."""
    points = on_axis(spectra, axis, key).select(F.posexplode("x").alias("pos", "v"))
    return points.groupBy("pos").agg(F.median("v").alias("reference")).select("pos", (F.lit(float(axis[0])) + F.col("pos") * F.lit(float(axis[1] - axis[0]) if len(axis) > 1 else 0.0)).alias("mz"), "reference")


def fit(spectra: DataFrame, step: float = 0.5, prominence: float = 1e-5, reference: str | int = "median", key: str = "spectrum_no") -> Reference:
    """The median spectrum of the common range, or the spectrum at a 0-based place in order of the key; the axis bounds what reaches the driver."""
    axis = common_axis(spectra, step, key)
    if reference == "median":
        signal = np.array([r["reference"] for r in reference_points(spectra, axis, key).orderBy("pos").collect()], float)
    elif isinstance(reference, int):
        rows = on_axis(usable(spectra, key).orderBy(key).offset(reference).limit(1), axis, key).collect() if reference >= 0 else []
        if not rows:
            raise ValueError(f"there is no spectrum {reference}")
        signal = np.asarray(rows[0]["x"], float)
    else:
        raise ValueError("reference is median or a place")
    peaks = axis[kernels.local_peaks(signal, prominence=prominence)]
    if len(peaks) < MIN_REFERENCE_PEAKS:
        warnings.warn(f"the reference has only {len(peaks)} peaks", stacklevel=2)
    return Reference(axis, signal, peaks)


def moved(spectra: DataFrame, reference: Reference, method: str = "shift", prominence: float = 1e-5, most: float = 10.0, key: str = "spectrum_no", **options) -> DataFrame:
    """(key, mz, intensity) with m/z moved so that the peaks meet those of the reference; intensities and order stay.

    With ``dtw`` the spectrum is put on the reference's axis and warped there. Too few peaks for a method fall back to the shift, none leave
    a spectrum as it is.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; known: {', '.join(METHODS)}")
    ref = reference

    def one(mz: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if method == "dtw":
            held = np.interp(ref.axis, mz, x, left=0.0, right=0.0)
            return ref.axis, kernels.align("dtw", ref.axis, held, ref.peaks, ref.peaks, ref.signal, **options)
        peaks = mz[kernels.local_peaks(x, prominence=prominence)]
        if not len(peaks) or not len(ref.peaks):
            return mz, x
        target = ref.peaks[kernels.nearest(peaks, ref.peaks)]
        need = {"linear": 2, "piecewise": 2, "quadratic": 3, "cubic": 4, "lowess": 3}
        if len(peaks) < need.get(method, 1) or method == "shift":
            return mz + kernels.shift_of(peaks, ref.peaks, most), x
        if method == "linear":
            slope, cut = kernels.robust_line(peaks, target)
            return slope * mz + cut, x
        if method == "piecewise":
            return mz + kernels.piecewise_offsets(peaks, target, mz, options.get("segments", 5), options.get("sigma", 2.0)), x
        if method == "lowess":
            return mz + np.interp(mz, peaks, kernels.lowess(peaks, target - peaks, options.get("share", 0.3), options.get("rounds", 3))), x
        # Numbers around 0 keep the fit of a cubic stable.
        centre, width = peaks.mean(), max(peaks.std(), 1e-9)
        return np.polyval(np.polyfit((peaks - centre) / width, target, {"quadratic": 2, "cubic": 3}[method]), (mz - centre) / width), x

    def run(frames):
        for f in frames:
            both = [one(np.asarray(m, float), np.asarray(v, float)) for m, v in zip(f["mz"], f["intensity"])]
            yield pd.DataFrame({key: f[key], "mz": [b[0] for b in both], "intensity": [b[1] for b in both]})

    rows = usable(spectra, key)
    return rows.mapInPandas(run, f"{key} {rows.schema[0].dataType.simpleString()}, mz array<double>, intensity array<double>")


def binned(spectra: DataFrame, edges: list[float], key: str = "spectrum_no") -> DataFrame:
    """(key, bin_index, intensity): points added up between the edges, zeros filled in, in the row of the spectrum; several rows of one key are averaged."""
    e = np.asarray(edges, float)

    def run(frames):
        for f in frames:
            out = []
            for m, v in zip(f["mz"], f["intensity"]):
                m, v = np.asarray(m, float), np.asarray(v, float)
                ok = (m >= e[0]) & (m <= e[-1])
                out.append(np.bincount(np.maximum(np.searchsorted(e, m[ok], "left") - 1, 0), v[ok], len(e) - 1))
            yield pd.DataFrame({key: f[key], "x": out})

    rows = usable(spectra, key)
    full = rows.mapInPandas(run, f"{key} {rows.schema[0].dataType.simpleString()}, x array<double>")
    return full.select(key, F.posexplode("x").alias("bin_index", "v")).groupBy(key, "bin_index").agg(F.avg("v").alias("intensity"))


def quality(before: DataFrame, after: DataFrame, reference: Reference, key: str = "spectrum_no") -> DataFrame:
    """(key, corr_before, corr_after, improvement): correlation with the reference on its axis; an undefined one counts as 0."""
    spark = before.sparkSession
    ref = spark.createDataFrame([(i, float(v)) for i, v in enumerate(reference.signal)], "pos int, reference double")

    def one(df: DataFrame, name: str) -> DataFrame:
        points = on_axis(df, reference.axis, key).select(key, F.posexplode("x").alias("pos", "v"))
        return points.join(ref, "pos").groupBy(key).agg(F.coalesce(correlation("v", "reference"), F.lit(0.0)).alias(name))

    both = one(before, "corr_before").join(one(after, "corr_after"), key)
    return both.withColumn("improvement", F.col("corr_after") - F.col("corr_before"))

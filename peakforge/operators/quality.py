"""Quality measures of single spectra, each one expression on the row's arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakforge.functions import kernels
from peakforge.functions.arrays import let, mad, median, quantile, total

NORMAL_QUARTILE = 0.6744897501960817
MAD_SCALE = 1.4826
MOST_SNR = 1e6


def within(mz: Column, x: Column, low: float, high: float) -> Column:
    """Intensities of the points with m/z in [low, high]."""
    p = F.filter(F.arrays_zip(mz.alias("mz"), x.alias("x")), lambda p: p["mz"].between(low, high))
    return F.transform(p, lambda p: p["x"].cast("double"))


def noise_level(region: Column) -> Column:
    """MAD over the normal quartile; 0 for an empty region."""
    return F.coalesce(mad(region) / NORMAL_QUARTILE, F.lit(0.0))


def mad_noise(x: Column, constant: float = MAD_SCALE) -> Column:
    return F.coalesce(mad(F.filter(x, lambda v: v.isNotNull() & ~F.isnan(v))) * constant, F.lit(0.0))


def baseline_fraction(x: Column, noise: Column) -> Column:
    """Share of points below twice the noise; 0 without noise."""
    below = F.size(F.filter(x, lambda v: v < 2 * noise))
    return F.when((noise == 0) | (F.size(x) == 0), F.lit(0.0)).otherwise(below / F.size(x))


def dynamic_range(x: Column) -> Column:
    """log10 of maximum over median of the points above the first decile; 0 if either isn't positive."""
    upper = let(quantile(x, 0.1), lambda q: F.filter(x, lambda v: v > q))

    def of(u: Column) -> Column:
        m, top = median(u), F.array_max(u)
        return F.when((F.size(u) > 0) & (m > 0) & (top > 0), F.log10(top / m)).otherwise(0.0)

    return let(upper, of)


def snr(x: Column, region: Column, top: int | None = None) -> Column:
    """Highest point, or the median of the ``top`` highest, over the scaled MAD of the noise region; at most 1e6, also without noise."""
    sigma = F.coalesce(mad(region) * MAD_SCALE, F.lit(0.0))
    signal = F.array_max(x) if top is None else median(F.slice(F.reverse(F.array_sort(x)), 1, top))
    return F.when(F.size(x) == 0, F.lit(0.0)).when(sigma > 0, F.least(signal / sigma, F.lit(MOST_SNR))).otherwise(F.lit(MOST_SNR))


#: Prominence that counts as a peak at least, and in multiples of the noise.
LEAST_PROMINENCE, NOISE_FACTOR = 1e-4, 3.0


def peak_count(spectra: DataFrame, noise: str = "noise", key: str = "spectrum_no") -> DataFrame:
    """(key, peak_count): peaks of prominence max(1e-4, 3 * noise) of each spectrum (key, intensity, noise); 0 for null and empty ones."""

    def run(frames):
        for f in frames:
            n = [0 if v is None or not len(v) else len(kernels.local_peaks(np.asarray(v, float), prominence=max(LEAST_PROMINENCE, NOISE_FACTOR * (0.0 if pd.isna(s) else s)))) for v, s in zip(f["intensity"], f[noise])]
            yield pd.DataFrame({key: f[key], "peak_count": np.array(n, "int32")})

    rows = spectra.select(key, "intensity", noise)
    return rows.mapInPandas(run, f"{key} {rows.schema[0].dataType.simpleString()}, peak_count int")


def full_report(spectra: DataFrame, key: str = "spectrum_no", low: float = 19500.0, high: float = 20000.0) -> DataFrame:
    """(key, snr, total_ion_count, peak_count, noise, baseline_fraction, dynamic_range) of spectra (key, mz, intensity); keys are unique."""
    p = spectra.select(key, "mz", "intensity").withColumn("_far", within(F.col("mz"), F.col("intensity"), low, high))
    p = p.withColumn("noise", noise_level(F.col("_far")))
    out = p.select(
        key, snr(F.col("intensity"), F.col("_far")).alias("snr"), total(F.col("intensity")).alias("total_ion_count"), "noise",
        baseline_fraction(F.col("intensity"), F.col("noise")).alias("baseline_fraction"), dynamic_range(F.col("intensity")).alias("dynamic_range"),
    )
    return out.join(peak_count(p, key=key), key)

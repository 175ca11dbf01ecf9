"""Per-spectrum transforms on arrays: one projection each, no shuffle, whole spectra in one row.

A spectrum is a row (id, mz array, intensity array). A null array stays null, an empty one stays empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakforge.functions import kernels
from peakforge.functions.arrays import doubles, let, median, total


def clip_negatives(x: Column) -> Column:
    return F.transform(x, lambda v: F.when(v < 0, F.lit(0.0)).otherwise(v))


def sqrt(x: Column) -> Column:
    """Square roots; NaN for negatives."""
    return F.transform(x, F.sqrt)


def log1p(x: Column) -> Column:
    return F.transform(x, F.log1p)


def tic(x: Column) -> Column:
    """Divided by the sum if that is positive, else unchanged."""
    return let(total(x), lambda t: F.when(t > 0, F.transform(x, lambda v: v / t)).otherwise(doubles(x)))


def median_normalised(x: Column) -> Column:
    """Divided by the median if that is positive, else unchanged."""
    return let(median(doubles(x)), lambda m: F.when(m > 0, F.transform(x, lambda v: v / m)).otherwise(doubles(x)))


def pqn(x: Column, reference: Column) -> Column:
    """Probabilistic quotient normalisation: sum first, then the median quotient over positive reference points.

    Spectra of another length than the reference are an error.
    """

    def apply(t: Column) -> Column:
        q = F.filter(F.zip_with(t, reference, lambda a, r: F.when(r > 0, a / r)), lambda v: v.isNotNull())
        return let(median(q), lambda m: F.when(m > 0, F.transform(t, lambda v: v / m)).otherwise(t))

    wrong = F.raise_error(F.lit("spectrum and reference differ in length")).cast("array<double>")
    return F.when(F.size(x) == F.size(reference), let(tic(x), apply)).otherwise(wrong)


def trim(points: Column, low: float, high: float) -> Column:
    """Points (struct with mz) within [low, high]."""
    return F.filter(points, lambda p: p["mz"].between(low, high))


def trim_ranges(points: Column, ranges: list[tuple[float, float]]) -> Column:
    """Points within any of the closed ranges."""
    return F.filter(points, lambda p: reduce(lambda a, b: a | b, [p["mz"].between(lo, hi) for lo, hi in ranges]))


def by_kernel(spectra: DataFrame, x: str, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``spectra`` with the array ``x`` put through a function of one numpy array, in Arrow batches; null arrays stay null, empty ones empty."""
    at = spectra.columns.index(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [None if v is None else kernel(np.asarray(v, float)) if len(v) else np.zeros(0) for v in b.column(at).to_numpy(zero_copy_only=False)]
            yield b.set_column(at, x, pa.array(cells, pa.list_(pa.float64())))

    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType()) if f.name == x else f.dataType) for f in spectra.schema])
    return spectra.mapInArrow(run, schema)


def moving_average(spectra: DataFrame, x: str, window: int = 5) -> DataFrame:
    """Centred mean over an odd window; beyond the ends the array is mirrored with its edge repeated."""
    if window < 3 or window % 2 == 0:
        raise ValueError("window must be odd and at least 3")
    return by_kernel(spectra, x, partial(kernels.moving_average, window=window))


def top_hat(spectra: DataFrame, x: str, half: int = 100) -> DataFrame:
    """Intensity above the grey opening of size 2*half+1; a window wider than the spectrum is an error."""
    if half < 1:
        raise ValueError("half window must be at least 1")
    return by_kernel(spectra, x, partial(kernels.top_hat, half=half))

"""Binning of spectra: right-closed m/z intervals, the first one closed on both sides; intensities are summed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakforge.functions.kernels import density_edges

LOW, HIGH, WIDTH = 2000.0, 20000.0, 3.0
LEAST_WIDTH = 1.0

Edges = Callable[..., list[float]]


def uniform_edges(low: float = LOW, high: float = HIGH, width: float = WIDTH) -> list[float]:
    if width < LEAST_WIDTH:
        raise ValueError("bins must be at least 1 Da wide")
    return [low + width * i for i in range(int(np.ceil((high - low) / width)) + 1)]


def proportional_edges(low: float = LOW, high: float = HIGH, width: float = WIDTH) -> list[float]:
    """Widths grow with m/z, as the resolution of the instrument falls; the first bin is ``width`` wide."""
    if low <= 0 or width < LEAST_WIDTH:
        raise ValueError("low must be positive and bins at least 1 Da wide")
    edges = [low]
    while edges[-1] < high:
        edges.append(edges[-1] + max(LEAST_WIDTH, width * edges[-1] / low))
    return edges


def checked_edges(edges: list[float], low: float = LOW, high: float = HIGH) -> list[float]:
    """Custom edges: at least two, ascending, covering the range, bins at least 1 Da wide."""
    e = [float(v) for v in edges]
    if len(e) < 2 or any(b - a < LEAST_WIDTH for a, b in zip(e, e[1:])) or e[0] > low or e[-1] < high:
        raise ValueError("edges must ascend by at least 1 Da and cover the range")
    return e


_BUILT_IN: dict[str, Edges] = {"uniform": uniform_edges, "proportional": proportional_edges}
_methods: dict[str, Edges] = dict(_BUILT_IN)


def register_binning(name: str, edges: Edges) -> None:
    """Add a method: a function of (low, high, width) that returns edges."""
    if not callable(edges):
        raise TypeError("a binning method is a function")
    _methods[name] = edges


def unregister_binning(name: str) -> None:
    if name in _BUILT_IN:
        raise ValueError(f"{name} is built in")
    del _methods[name]


def edges_of(method: str, low: float = LOW, high: float = HIGH, width: float = WIDTH) -> list[float]:
    if method not in _methods:
        raise ValueError(f"unknown binning method {method}; known: {', '.join(sorted(_methods))}")
    return _methods[method](low, high, width)


def bin_table(spark: SparkSession, edges: list[float]) -> DataFrame:
    """(bin_index, bin_start, bin_end, bin_width)."""
    rows = [(i, float(a), float(b), float(b - a)) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    return spark.createDataFrame(rows, "bin_index int, bin_start double, bin_end double, bin_width double")


def uniform_bin(mz: Column, low: float, width: float, n: int) -> Column:
    """Index of the uniform bin, null outside."""
    at = F.greatest(F.ceil((mz - F.lit(low)) / F.lit(width)) - 1, F.lit(0))
    return F.when((mz >= low) & (at < n), at.cast("int"))


def edge_bin(mz: Column, edges: list[float]) -> Column:
    """Index of the bin among any ascending edges by binary search in one expression, null outside."""
    e = F.array(*[F.lit(float(v)) for v in edges])
    steps = int(np.ceil(np.log2(len(edges)))) + 1

    def search(table: Column) -> Column:
        state = F.struct(F.lit(0).alias("lo"), F.lit(len(edges) - 1).alias("hi"))

        def halve(s: Column, _: Column) -> Column:
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            left = F.get(table, mid) >= mz
            return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(left, s["lo"]).otherwise(mid + 1).alias("lo"), F.when(left, mid).otherwise(s["hi"]).alias("hi")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, halve)["lo"]

    first = F.get(F.transform(F.array(e), search), F.lit(0))
    return F.when(mz.between(edges[0], edges[-1]), F.greatest(first - 1, F.lit(0)))


def bin_points(points: DataFrame, index: Column, n_bins: int, key: str = "spectrum_no", fill: bool = True) -> DataFrame:
    """(key, bin_index, intensity) from rows (key, mz, intensity); with ``fill`` every bin of every spectrum has a row.

    Points outside the bins are dropped, null intensities count as 0. With zeros, the points of one spectrum are brought together
    once and added up in an array over the bins: one shuffle, no join.
    """
    rows = points.withColumn("bin_index", index)
    if not fill:
        return rows.where("bin_index is not null").groupBy(key, "bin_index").agg(F.sum(F.coalesce("intensity", F.lit(0.0))).alias("intensity"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = (b.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            yield b.select([0]).append_column("x", pa.array([np.bincount(np.asarray(i, int), np.asarray(v, float), n_bins) for i, v in zip(at, x)], pa.list_(pa.float64())))

    inside = F.col("bin_index").isNotNull()
    one = rows.groupBy(key).agg(F.collect_list(F.when(inside, F.col("bin_index"))).alias("at"), F.collect_list(F.when(inside, F.coalesce("intensity", F.lit(0.0)))).alias("v"))
    full = one.mapInArrow(run, T.StructType([one.schema[0], T.StructField("x", T.ArrayType(T.DoubleType()))]))
    return full.select(key, F.posexplode("x").alias("bin_index", "intensity"))


def adaptive_bins(spectra: DataFrame, low: float = LOW, high: float = HIGH, narrow: float = 1.0, wide: float = 10.0, key: str = "spectrum_no") -> DataFrame:
    """(key, bin_index, bin_start, bin_end, intensity) with edges fitted to each spectrum's own peaks."""

    def run(frames):
        for f in frames:
            out = []
            for k, mz, x in zip(f[key], f["mz"], f["intensity"]):
                if mz is None or x is None:
                    continue
                mz, x = np.asarray(mz, float), np.asarray(x, float)
                e = density_edges(mz, x, low, high, narrow, wide)
                at = np.maximum(np.searchsorted(e, mz, "left") - 1, 0)
                ok = (mz >= e[0]) & (mz <= e[-1])
                sums = np.bincount(at[ok], weights=x[ok], minlength=len(e) - 1)
                out.append(pd.DataFrame({key: k, "bin_index": np.arange(len(e) - 1, dtype="int32"), "bin_start": e[:-1], "bin_end": e[1:], "intensity": sums}))
            if out:
                yield pd.concat(out)

    return spectra.select(key, "mz", "intensity").mapInPandas(run, f"{key} bigint, bin_index int, bin_start double, bin_end double, intensity double")

"""Peak detection and peak sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakforge.functions import kernels
from peakforge.operators.transforms import by_kernel


def with_maxima(spectra: DataFrame, x: str, out: str = "peaks") -> DataFrame:
    """Adds the 0-based places of local maxima of an array: a strict rise before, a strict fall behind, never at the ends.

    A plateau counts once, at its middle rounded down. Null arrays give null, short ones none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [None if v is None else kernels.local_peaks(np.asarray(v, float)).astype(np.int32) for v in b.column(b.schema.get_field_index(x)).to_numpy(zero_copy_only=False)]
            yield b.append_column(out, pa.array(cells, pa.list_(pa.int32())))

    return spectra.mapInArrow(run, T.StructType([*spectra.schema, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def peak_rows(spectra: DataFrame, x: str, key: str = "spectrum_no") -> DataFrame:
    """(key, pos, intensity): one row per local maximum."""
    return with_maxima(spectra.select(key, x), x).select(key, x, F.explode("peaks").alias("pos")).select(key, "pos", F.get(x, F.col("pos")).cast("double").alias("intensity"))


def peak_mask(spectra: DataFrame, x: str, out: str = "mask", binary: bool = True) -> DataFrame:
    """Adds an array of 1 (or the intensity) at peaks, 0 elsewhere."""

    def mask(v: np.ndarray) -> np.ndarray:
        m = np.zeros(len(v))
        p = kernels.local_peaks(v)
        m[p] = 1.0 if binary else v[p]
        return m

    return by_kernel(spectra.withColumn(out, F.col(x)), out, mask)


def _heights(spectra: DataFrame, x: str, *keep: str) -> DataFrame:
    return with_maxima(spectra.select(*keep, x), x).withColumn("h", F.transform("peaks", lambda p: F.get(x, p).cast("double")))


def peak_statistics(spectra: DataFrame, x: str, key: str = "spectrum_no") -> DataFrame:
    """(key, n_peaks, mean_intensity, max_intensity); zeros for spectra without peaks."""
    one = _heights(spectra, x, key).where("h is not null")
    mean = F.aggregate("h", F.lit(0.0), lambda s, v: s + v) / F.size("h")
    return one.select(key, F.size("h").alias("n_peaks"), F.when(F.size("h") > 0, mean).otherwise(0.0).alias("mean_intensity"), F.coalesce(F.array_max("h"), F.lit(0.0)).alias("max_intensity"))


#: Spectra that an export as one array may hold.
MOST_PADDED = 100_000
RANKS = ("intensity", "prominence", "persistence")


def ranked_peaks(mz: np.ndarray, x: np.ndarray, k: int, rank_by: str, method: str, options: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mz, intensity, score) of the k best peaks in order of m/z; of equal scores the later one stays."""
    if method == "ph":
        p, score = kernels.persistence_peaks(x, options.get("threshold", 1e-6))
    else:
        p = kernels.local_peaks(x, **options)
        score = kernels.prominences(x, p) if rank_by == "prominence" else x[p]
    if rank_by == "intensity":
        score = x[p]
    top = np.sort(np.argsort(-score[::-1], kind="stable")[:k])
    top = np.sort(len(p) - 1 - top) if len(p) else top
    return mz[p[top]], x[p[top]], score[top]


def peak_set(spectra: DataFrame, mz: str, x: str, k: int = 200, key: str = "spectrum_no", rank_by: str = "intensity", method: str = "local", **options) -> DataFrame:
    """(key, mz array, intensity array, score array): the k best peaks by intensity, prominence or persistence in order of m/z.

    Of equal scores the later peak stays. Persistence needs method ``ph``. Null arrays give no row, spectra without peaks empty arrays.
    """
    if rank_by not in RANKS or method not in ("local", "ph") or k < 1:
        raise ValueError("rank_by is intensity, prominence or persistence, method local or ph, k positive")
    if (rank_by == "persistence" and method != "ph") or (rank_by == "prominence" and method == "ph"):
        raise ValueError("persistence goes with ph, prominence with local")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [ranked_peaks(np.asarray(m, float), np.asarray(v, float), k, rank_by, method, options) for m, v in zip(*(b.column(c).to_numpy(zero_copy_only=False) for c in (1, 2)))]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([s[i] for s in sets], pa.list_(pa.float64())) for i in range(3)]], [key, "mz", "intensity", "score"])

    rows = spectra.select(key, F.col(mz).alias("mz"), F.col(x).alias("x")).where("mz is not null and x is not null")
    list_ = T.ArrayType(T.DoubleType())
    return rows.mapInArrow(run, T.StructType([rows.schema[0], *[T.StructField(c, list_) for c in ("mz", "intensity", "score")]]))


def detected(spectra: DataFrame, x: str, method: str = "local", key: str = "spectrum_no", **options) -> DataFrame:
    """(key, pos, intensity, score): peaks with prominence or persistence, computed spectrum by spectrum in Arrow batches.

    ``local`` takes prominence, height and distance and scores by prominence; ``ph`` takes threshold and scores by persistence.
    """
    if method not in ("local", "ph"):
        raise ValueError("method is local or ph")

    def run(frames):
        for f in frames:
            out = []
            for k, v in zip(f[key], f[x]):
                if v is None or not len(v):
                    continue
                v = np.asarray(v, float)
                if method == "local":
                    p = kernels.local_peaks(v, **options)
                    s = kernels.prominences(v, p)
                else:
                    p, s = kernels.persistence_peaks(v, options.get("threshold", 1e-6))
                out.append(pd.DataFrame({key: k, "pos": p.astype("int32"), "intensity": v[p], "score": s}))
            if out:
                yield pd.concat(out)

    return spectra.select(key, x).mapInPandas(run, f"{key} bigint, pos int, intensity double, score double")


def padded(sets: DataFrame, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """((n, P, 2) float32, (n, P) mask) of a peak table (key, mz, intensity) of at most MOST_PADDED rows, in order of key; export only."""
    if sets.limit(MOST_PADDED + 1).count() > MOST_PADDED:
        raise ValueError(f"more than {MOST_PADDED} spectra; export them in parts")
    rows = sets.orderBy(sets.columns[0]).toPandas()
    size = most or max((len(m) for m in rows["mz"]), default=0)
    out, mask = np.zeros((len(rows), size, 2), np.float32), np.zeros((len(rows), size), bool)
    for i, (m, x) in enumerate(zip(rows["mz"], rows["intensity"])):
        m, x = np.asarray(m, float), np.asarray(x, float)
        keep = np.sort(np.argsort(-x, kind="stable")[:size])
        out[i, : len(keep), 0], out[i, : len(keep), 1], mask[i, : len(keep)] = m[keep], x[keep], True
    return out, mask

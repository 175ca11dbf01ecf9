"""Peak sets of whole folders, kept on disk under a hash of what they were made of."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakforge.operators import peaks, replicates
from peakforge.operators.pipeline import Pipeline
from peakforge.sources import text
from peakforge.sources.layouts import children


def save(sets: DataFrame, path: str) -> None:
    """Peak sets (key, mz, intensity, further columns) as a parquet table."""
    sets.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table made by :func:`save`; one without mz and intensity is an error."""
    sets = spark.read.parquet(path)
    if not {"mz", "intensity"} <= set(sets.columns):
        raise ValueError("the table holds no peak sets")
    return sets


def fingerprint(spectra: DataFrame, key: str, **options) -> str:
    """Hash of the content of all spectra, in whatever order they stand, and of the options; one aggregate over the table."""
    row = spectra.select(F.xxhash64(key, "mz", "intensity").alias("h"), F.hash(key, "mz", "intensity").alias("g")).agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.col("g").cast("bigint"))).first()
    return hashlib.sha256(json.dumps([list(row), options], sort_keys=True, default=str).encode()).hexdigest()[:32]


def detected(spectra: DataFrame, key: str = "spectrum_id", k: int = 200, rank_by: str = "intensity", method: str = "local", cache: str | None = None, **options) -> DataFrame:
    """Peak sets of the spectra (key, mz, intensity), read from the folder ``cache`` if the same content was worked on with the same options before."""
    make = lambda: peaks.peak_set(spectra, "mz", "intensity", k, key, rank_by, method, **options)
    if cache is None:
        return make()
    spark, path = spectra.sparkSession, f"{cache.rstrip('/')}/{fingerprint(spectra, key, k=k, rank_by=rank_by, method=method, **options)}"
    if "_SUCCESS" not in children(spark, path):
        save(make(), path)
    return load(spark, path)


def from_directory(spark: SparkSession, directory: str, ids: DataFrame | None = None, glob: str = "*.txt", duplicates: str = "first", pipeline: Pipeline | None = None, cache: str | None = None, **how) -> DataFrame:
    """(spectrum_id, mz, intensity, score) of all text spectra below a folder, or of those named by ``ids`` (spectrum_id); no binning.

    ``how`` goes to :func:`detected`. Files without a valid line have no peak set.
    """
    s = text.read_spectra(spark, directory, glob).where(F.size("mz") > 0)
    if ids is not None:
        s = s.join(ids.select("spectrum_id").distinct(), "spectrum_id", "left_semi")
    s = replicates.resolve_duplicates(s, "spectrum_id", ["path"], duplicates)
    return detected((pipeline or Pipeline.default()).run(s.select("spectrum_id", "mz", "intensity"), "spectrum_id"), cache=cache, **how)

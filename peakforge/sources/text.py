"""Spectra in text files: one row per file, parsed with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    """File name without its last ending."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def parse_points(text: Column) -> Column:
    """array<struct<mz, intensity>> of all lines whose first two fields are numbers, in file order.

    Comma, semicolon, tab and blanks all separate, runs of them once, so no delimiter needs to be known; other lines are dropped.
    """

    def point(line: Column) -> Column:
        f = F.split(F.trim(F.regexp_replace(line, "[,;\t ]+", " ")), " ")
        return F.struct(F.get(f, F.lit(0)).try_cast("double").alias("mz"), F.get(f, F.lit(1)).try_cast("double").alias("intensity"))

    points = F.transform(F.split(text, r"\r\n|\r|\n"), point)
    return F.filter(points, lambda p: p["mz"].isNotNull() & p["intensity"].isNotNull())


def read_spectra(spark: SparkSession, path: str, glob: str = "*.txt", recursive: bool = True) -> DataFrame:
    """(spectrum_id, path, mz, intensity) of all matching files; a file without any valid line has empty arrays.

    Files are read whole, so a spectrum must fit into a row; for millions of them merge the files first.
    """
    raw = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=recursive)
    path_ = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    p = raw.select(path_.alias("path"), parse_points(F.col("value")).alias("p"))
    return p.select(stem(F.col("path")).alias("spectrum_id"), "path", F.transform("p", lambda v: v["mz"]).alias("mz"), F.transform("p", lambda v: v["intensity"]).alias("intensity"))


def failed(spectra: DataFrame) -> DataFrame:
    """(spectrum_id, path, reason) of files without a valid line."""
    return spectra.where(F.size("mz") == 0).select("spectrum_id", "path", F.lit("no numeric line").alias("reason"))


def raw_input(spark: SparkSession, path: str, glob: str = "*.txt", ids: DataFrame | None = None, strategy: str = "first") -> DataFrame:
    """(sample_id, path) of matching files, restricted to ``ids`` (sample_id) if given, with duplicate ids resolved in order of paths."""
    from peakforge.operators.replicates import resolve_duplicates

    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path")
    found = found.select(stem(F.col("path")).alias("sample_id"), "path")
    if ids is not None:
        found = found.join(ids.select("sample_id").distinct(), "sample_id", "left_semi")
    return resolve_duplicates(found, "sample_id", ["path"], strategy)

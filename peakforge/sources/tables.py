"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    """Read ``directory/name.parquet``; only the named columns reach the scan."""
    df = spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df

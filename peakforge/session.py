"""Session helpers: configuration for local runs and lineage cuts that survive lost executors."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "peakforge", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the submitted configuration is used instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", os.environ.get("PEAKFORGE_SHARED_DIR") or "file://" + tempfile.mkdtemp(prefix="peakforge-"))
        .config("spark.driver.memory", os.environ.get("PEAKFORGE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. An error where none is configured; a machine's own folder would lose rows on a cluster."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        raise RuntimeError("spark.checkpoint.dir names no shared folder; intermediate tables need one")
    return conf


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and lost executors cost no rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/peakforge/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shared(df: DataFrame) -> None:
    """Delete a table made by :func:`write_shared`, folder included, once nothing reads it any more."""
    spark = df.sparkSession
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the session drop shuffle files nothing refers to any more, so that the rounds of an iteration don't pile up on the disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fitting(df: DataFrame, most: int = 16_000_000) -> DataFrame:
    """``df`` with a broadcast hint if the files behind it take at most ``most`` bytes, else unchanged for the planner to shuffle.

    ``df`` should be a table made by :func:`write_shared`, or part of its rows or columns.
    """
    spark = df.sparkSession
    fs, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    size = 0
    for file in df.inputFiles():
        path = fs.Path(file)
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
        if size > most:
            return df
    return F.broadcast(df)

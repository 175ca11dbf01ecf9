"""Drift of arriving spectra, an extension of the batch windows: mean spectra per tumbling event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_means(stream: DataFrame, days: int = 30, late_days: int = 7, ts: str = "ts") -> DataFrame:
    """(window, bin_index, n, mean) of streamed rows (key, ts, bin_index, intensity), windows from the Unix epoch.

    Rows more than ``late_days`` behind the newest are dropped by the watermark; means are mergeable, so state is one row per window and bin.
    """
    w = F.window(F.col(ts).cast("timestamp"), f"{days} days")
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{late_days} days").groupBy(w.alias("window"), "bin_index").agg(F.count(F.lit(1)).alias("n"), F.avg("intensity").alias("mean"))


def distances(means: DataFrame, reference: DataFrame) -> DataFrame:
    """(window_start, n_spectra, distance_to_reference): cosine distance of the windows' means (a batch of them) to a reference (bin_index, reference)."""
    j = means.join(F.broadcast(reference), "bin_index")
    g = j.groupBy("window").agg(F.max("n").alias("n_spectra"), F.sum(F.col("mean") * F.col("reference")).alias("mr"), F.sum(F.col("mean") ** 2).alias("mm"), F.sum(F.col("reference") ** 2).alias("rr"))
    d = F.when((F.col("mm") > 0) & (F.col("rr") > 0), F.greatest(1 - F.col("mr") / F.sqrt(F.col("mm") * F.col("rr")), F.lit(0.0))).otherwise(1.0)
    return g.select(F.col("window.start").alias("window_start"), "n_spectra", d.alias("distance_to_reference"))

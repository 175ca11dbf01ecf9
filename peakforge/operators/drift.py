"""Drift of spectra over time: tumbling windows behind a baseline.

``matrix`` has key, ts, bin_index, intensity. Windows are closed on the left and start at the midnight of the first time stamp behind the baseline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakforge.operators.differential import analysis, class_moments, corrected, effect_size, rank_sum_p, rank_sums, top

DAY = 86_400


def timestamps(rows: DataFrame, ts: str) -> DataFrame:
    """``rows`` with ``ts`` as timestamp; a value that can't be read as one is an error that names it, nulls are one too."""
    text = F.col(ts).cast("string")
    read = text.try_cast("timestamp")
    wrong = F.raise_error(F.concat(F.lit(f"{ts} holds no time: "), F.coalesce(text, F.lit("null")))).cast("timestamp")
    return rows.withColumn(ts, F.coalesce(read, wrong).cast("timestamp_ntz"))


class Monitor:
    """A baseline fitted once, against which later windows are measured.

    ``matrix`` has key, ts, bin_index, intensity, and y where effects or stability are asked for. Fewer than two baseline spectra are an error.
    """

    def __init__(self, share: float = 0.2, days: int = 30, min_samples: int = 5, key: str = "spectrum_no", ts: str = "ts") -> None:
        if not 0 < share < 1 or days < 1:
            raise ValueError("share lies between 0 and 1, days are positive")
        self.share, self.days, self.min_samples, self.key, self.ts, self.cut = share, days, min_samples, key, ts, None

    def fit(self, matrix: DataFrame) -> Monitor:
        times = matrix.select(self.key, self.ts).distinct()
        row = baseline_end(times, self.ts, self.share).first()
        if row is None or times.where(F.col(self.ts) <= F.lit(row["cut"])).limit(2).count() < 2:
            raise ValueError("the baseline needs at least two spectra")
        self.cut = row["cut"]
        return self

    def _how(self) -> dict:
        if self.cut is None:
            raise ValueError("fit the monitor first")
        return {"days": self.days, "min_samples": self.min_samples, "ts": self.ts}

    def reference(self, matrix: DataFrame) -> DataFrame:
        return reference_drift(matrix, self.cut, key=self.key, **self._how())

    def pca(self, matrix: DataFrame, k: int = 2) -> DataFrame:
        return pca_drift(matrix, self.cut, k=k, key=self.key, **self._how())

    def stability(self, matrix: DataFrame, n_top: int = 20) -> DataFrame:
        return tested_stability(matrix, self.cut, n_top=n_top, **self._how())

    def effects(self, matrix: DataFrame, bins: list[int]) -> DataFrame:
        return window_effects(matrix, self.cut, bins, key=self.key, **self._how())


def baseline_end(times: DataFrame, ts: str = "ts", share: float = 0.2):
    """The time stamp at the end of the first ``share`` of the sorted times, as a one-row frame (cut).

    Counting per day first leaves a single small window; only the day of the cut is sorted.
    """
    t = times.where(F.col(ts).isNotNull()).select(F.col(ts).alias("ts"))
    days = t.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    days = days.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    at = F.greatest(F.ceil(F.col("all") * share) - 1, F.lit(0))
    day = days.where((F.col("before") <= at) & (at < F.col("before") + F.col("n"))).select("day", (at - F.col("before")).alias("k"))
    r = t.withColumn("day", F.to_date("ts")).join(F.broadcast(day), "day").withColumn("r", F.row_number().over(Window.orderBy("ts")) - 1)
    return r.where("r = k").select(F.col("ts").alias("cut"))


def windowed(rows: DataFrame, cut, days: int = 30, ts: str = "ts") -> DataFrame:
    """Rows behind the baseline with window_start; ``cut`` is a literal time stamp of the driver."""
    late = rows.where(F.col(ts) > F.lit(cut))
    origin = late.agg(F.date_trunc("day", F.min(ts)).alias("o")).first()["o"]
    if origin is None:
        return late.withColumn("window_start", F.col(ts))
    seconds = days * DAY
    step = F.floor((F.unix_timestamp(F.col(ts).cast("timestamp")) - F.unix_timestamp(F.lit(origin).cast("timestamp"))) / seconds)
    start = F.timestamp_seconds(F.unix_timestamp(F.lit(origin).cast("timestamp")) + step * seconds)
    return late.withColumn("window_start", start.cast("timestamp_ntz"))


def reference_drift(matrix: DataFrame, cut, days: int = 30, min_samples: int = 5, key: str = "spectrum_no", ts: str = "ts") -> DataFrame:
    """(window_start, window_end, n_spectra, distance_to_reference): cosine distance of each window's median spectrum to the baseline's."""
    reference = matrix.where(F.col(ts) <= F.lit(cut)).groupBy("bin_index").agg(F.median("intensity").alias("r"))
    late = windowed(matrix, cut, days, ts)
    n = late.groupBy("window_start").agg(F.count_distinct(key).alias("n_spectra")).where(F.col("n_spectra") >= min_samples)
    med = late.join(F.broadcast(n), "window_start").groupBy("window_start", "n_spectra", "bin_index").agg(F.median("intensity").alias("m")).join(F.broadcast(reference), "bin_index")
    m, r = F.col("m"), F.col("r")
    g = med.groupBy("window_start", "n_spectra").agg(F.sum(m * r).alias("mr"), F.sum(m * m).alias("mm"), F.sum(r * r).alias("rr"))
    d = F.when((F.col("mm") > 0) & (F.col("rr") > 0), 1 - F.col("mr") / F.sqrt(F.col("mm") * F.col("rr"))).otherwise(1.0)
    return g.select("window_start", (F.col("window_start") + F.make_dt_interval(F.lit(days))).alias("window_end"), "n_spectra", F.greatest(d, F.lit(0.0)).alias("distance_to_reference"))


def window_effects(matrix: DataFrame, cut, bins: list[int], days: int = 30, min_samples: int = 5, key: str = "spectrum_no", ts: str = "ts") -> DataFrame:
    """(window_start, bin_index, effect_size, n_spectra) of the listed bins in windows with at least min_samples of each class; needs y."""
    late = windowed(matrix.where(F.col("bin_index").isin(bins)), cut, days, ts)
    m = class_moments(late, ["window_start"]).where((F.col("n_r") >= min_samples) & (F.col("n_s") >= min_samples))
    return m.select("window_start", "bin_index", effect_size().alias("effect_size"), (F.col("n_r") + F.col("n_s")).alias("n_spectra"))


def peak_stability(matrix: DataFrame, baseline_top: list[int], cut, days: int = 30, n_top: int = 20, min_samples: int = 5, ts: str = "ts") -> DataFrame:
    """(window_start, stability_score, n_spectra): Jaccard index of each window's bins of largest effect with the baseline's; both empty is 1."""
    late = windowed(matrix, cut, days, ts)
    m = class_moments(late, ["window_start"]).where((F.col("n_r") >= min_samples) & (F.col("n_s") >= min_samples)).withColumn("d", F.round(F.abs(effect_size()), 9))
    w = Window.partitionBy("window_start").orderBy(F.desc("d"), "bin_index")
    top = m.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n_top).groupBy("window_start").agg(F.collect_list("bin_index").alias("bins"), F.max(F.col("n_r") + F.col("n_s")).alias("n_spectra"))
    base = F.array(*[F.lit(int(b)) for b in baseline_top]).cast("array<int>")
    union = F.size(F.array_union("bins", base))
    return top.select("window_start", F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("bins", base)) / union).alias("stability_score"), "n_spectra")


def tested_stability(matrix: DataFrame, cut, days: int = 30, n_top: int = 20, min_samples: int = 5, ts: str = "ts") -> DataFrame:
    """(window_start, stability_score, n_spectra): Jaccard index of each window's top bins with the baseline's; both empty is 1.

    Top are the bins of smallest adjusted p of the rank-sum test, within the baseline and within each window; ties in order of bins.
    """
    base = [r["bin_index"] for r in top(analysis(matrix.where(F.col(ts) <= F.lit(cut))), n_top).select("bin_index").collect()]
    u = rank_sums(windowed(matrix, cut, days, ts), ["window_start"]).where((F.col("n_r") >= min_samples) & (F.col("n_s") >= min_samples))
    p = corrected(u.withColumn("p_value", rank_sum_p()), by=["window_start"])
    k = F.row_number().over(Window.partitionBy("window_start").orderBy("adjusted_p_value", "bin_index"))
    g = p.withColumn("k", k).where(F.col("k") <= n_top).groupBy("window_start").agg(F.collect_list("bin_index").alias("bins"), F.max(F.col("n_r") + F.col("n_s")).alias("n_spectra"))
    first = F.array(*[F.lit(int(b)) for b in base]).cast("array<int>")
    union = F.size(F.array_union("bins", first))
    return g.select("window_start", F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("bins", first)) / union).alias("stability_score"), "n_spectra")


def principal_axes(matrix: DataFrame, k: int = 2, key: str = "spectrum_no"):
    """(means, scales, loadings) of standardised bins from the covariance aggregated by Spark; the largest loading of an axis is positive.

    The number of bins bounds what reaches the driver: one covariance matrix.
    """
    import numpy as np
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    rows = matrix.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("bin_index", "intensity"))).alias("b")).select(key, array_to_vector(F.transform("b", lambda s: s["intensity"])).alias("v"))
    scaler = StandardScaler(inputCol="v", outputCol="s", withMean=True, withStd=True).fit(rows)
    model = PCA(k=k, inputCol="s", outputCol="pc").fit(scaler.transform(rows))
    load = model.pc.toArray()
    sign = np.sign(load[np.abs(load).argmax(axis=0), np.arange(load.shape[1])])
    return scaler.mean.toArray(), scaler.std.toArray(), load * np.where(sign == 0, 1, sign)


def pca_drift(matrix: DataFrame, cut, days: int = 30, k: int = 2, min_samples: int = 5, key: str = "spectrum_no", ts: str = "ts") -> DataFrame:
    """(window_start, n_spectra, centroid_pc1, centroid_pc2, dispersion): windows in the plane of the baseline's principal axes."""
    mean, std, load = principal_axes(matrix.where(F.col(ts) <= F.lit(cut)), k, key)
    table = [(i, float(mean[i]), float(std[i]) or 1.0, float(load[i, 0]), float(load[i, 1])) for i in range(len(mean))]
    axes = matrix.sparkSession.createDataFrame(table, "bin_index int, _m double, _s double, _a double, _b double")
    late = windowed(matrix, cut, days, ts).join(F.broadcast(axes), "bin_index")
    z = (F.col("intensity") - F.col("_m")) / F.col("_s")
    points = late.groupBy("window_start", key).agg(F.sum(z * F.col("_a")).alias("a"), F.sum(z * F.col("_b")).alias("b"))
    g = points.groupBy("window_start").agg(F.count(F.lit(1)).alias("n_spectra"), F.avg("a").alias("centroid_pc1"), F.avg("b").alias("centroid_pc2")).where(F.col("n_spectra") >= min_samples)
    far = F.sqrt((F.col("a") - F.col("centroid_pc1")) ** 2 + (F.col("b") - F.col("centroid_pc2")) ** 2)
    return points.join(F.broadcast(g), "window_start").groupBy("window_start", "n_spectra", "centroid_pc1", "centroid_pc2").agg(F.avg(far).alias("dispersion"))

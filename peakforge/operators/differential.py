"""Differential analysis of binned spectra: one aggregate per bin instead of a loop over bins.

``matrix`` has key, bin_index, intensity and y (1 resistant, 0 susceptible). Rows with null y are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakforge.functions import stats
from peakforge.functions.numbers import running_total, with_ranges


def class_moments(matrix: DataFrame, by: list[str] = ()) -> DataFrame:
    """Per bin: n, mean and sample variance of both classes."""
    r, s = (F.when(F.col("y") == v, F.col("intensity")) for v in (1, 0))
    return matrix.where("y in (0, 1)").groupBy(*by, "bin_index").agg(
        F.count(r).alias("n_r"), F.count(s).alias("n_s"), F.avg(r).alias("mean_r"), F.avg(s).alias("mean_s"), F.var_samp(r).alias("var_r"), F.var_samp(s).alias("var_s")
    )


def effect_size() -> Column:
    """Cohen's d with pooled variance; 0 for classes of fewer than two or without variance."""
    n1, n2 = F.col("n_r"), F.col("n_s")
    pooled = F.try_divide((n1 - 1) * F.col("var_r") + (n2 - 1) * F.col("var_s"), n1 + n2 - 2)
    return F.when((n1 < 2) | (n2 < 2) | ~(pooled > 0), F.lit(0.0)).otherwise(F.try_divide(F.col("mean_r") - F.col("mean_s"), F.sqrt(pooled)))


def with_fold_change(moments: DataFrame, by: list[str] = ()) -> DataFrame:
    """Adds fold_change = log2 of the means' ratio, both raised by a thousandth of the median over the bins of |mean_r|+|mean_s|."""
    level = moments.groupBy(*by).agg(F.median(F.abs("mean_r") + F.abs("mean_s")).alias("_m")) if by else None
    if by:
        joined = moments.join(level, list(by))
    else:
        joined = moments.withColumn("_m", F.median(F.abs("mean_r") + F.abs("mean_s")).over(Window.partitionBy()))
    e = F.greatest(F.col("_m") * 1e-3, F.lit(1e-12))
    return joined.withColumn("fold_change", F.log2((F.col("mean_r") + e) / (F.col("mean_s") + e))).drop("_m")


def rank_sums(matrix: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by..., bin_index, n_r, n_s, u, ties): Mann-Whitney U of class 1 with average ranks, and the sum of t^3 - t over ties.

    Equal values of a bin are counted first, so a bin full of zeros is one row; ranks are running totals over distinct values, summed in value ranges first.
    """
    per = matrix.where("y in (0, 1)").groupBy(*by, "bin_index", "intensity").agg(F.count_if(F.col("y") == 1).alias("r"), F.count(F.lit(1)).alias("t"))
    ranked = running_total(with_ranges(per, "intensity", [*by, "bin_index"]), "t", F.col("_r"), ["intensity"], [*by, "bin_index"])
    ranked = ranked.withColumn("rank", F.col("before") + (F.col("t") + 1) / 2)
    g = ranked.groupBy(*by, "bin_index").agg(F.sum("r").alias("n_r"), (F.sum("t") - F.sum("r")).alias("n_s"), F.sum(F.col("rank") * F.col("r")).alias("w"), F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    return g.select(*by, "bin_index", "n_r", "n_s", (F.col("w") - F.col("n_r") * (F.col("n_r") + 1) / 2).alias("u"), F.col("ties").cast("double").alias("ties"))


def rank_sum_p() -> Column:
    """p of a row of ``rank_sums``; 1 where all values are equal."""
    n = F.col("n_r") + F.col("n_s")
    return stats.mann_whitney(F.when(F.col("ties") < n**3 - n, F.col("u")), F.col("n_r"), F.col("n_s"), F.col("ties"))


def welch(moments: DataFrame) -> DataFrame:
    """Adds t and df; null where a class has fewer than two values or nothing varies."""
    a, b = F.try_divide("var_r", "n_r"), F.try_divide("var_s", "n_s")
    ok = (F.col("n_r") > 1) & (F.col("n_s") > 1) & (a + b > 0)
    t = F.try_divide(F.col("mean_r") - F.col("mean_s"), F.sqrt(a + b))
    df = F.try_divide((a + b) ** 2, F.try_divide(a**2, F.col("n_r") - 1) + F.try_divide(b**2, F.col("n_s") - 1))
    return moments.withColumn("t", F.when(ok, t)).withColumn("df", F.when(ok, df))


def corrected(p_values: DataFrame, p: str = "p_value", method: str = "fdr_bh", order: str = "bin_index", out: str = "adjusted_p_value", by: list[str] = ()) -> DataFrame:
    """Adds the adjusted p over all rows of a group with a p; the others get 1. One row per bin, so one task per group is enough."""
    known = F.when(F.isnan(p), None).otherwise(F.col(p))
    all_ = Window.partitionBy(*by)
    m = F.count(known).over(all_)
    w = all_.orderBy(F.col("_p").asc_nulls_last(), order)
    d = p_values.withColumn("_p", known).withColumn("_m", m).withColumn("_k", F.row_number().over(w))
    if method == "bonferroni":
        adj = F.least(F.lit(1.0), F.col("_p") * F.col("_m"))
    elif method in ("fdr_bh", "fdr_by"):
        d = d.withColumn("_q", F.col("_p") * F.col("_m") / F.col("_k"))
        if method == "fdr_by":
            harmonic = F.sum(F.when(F.col("_k") <= F.col("_m"), 1 / F.col("_k"))).over(all_)
            d = d.withColumn("_q", F.col("_q") * harmonic)
        adj = F.least(F.lit(1.0), F.min("_q").over(all_.orderBy("_k").rowsBetween(0, Window.unboundedFollowing)))
    else:
        raise ValueError(f"unknown correction {method}")
    d = d.withColumn(out, F.when(F.col("_p").isNull(), F.lit(1.0)).otherwise(adj))
    return d.drop("_p", "_m", "_k", "_q")


def analysis(matrix: DataFrame, test: str = "mann_whitney", correction: str = "fdr_bh", ranges: list[tuple[float, float]] | None = None, peak_bins: DataFrame | None = None, start: str = "bin_start", by: list[str] = ()) -> DataFrame:
    """(by..., bin_index, mean_r, mean_s, fold_change, p_value, adjusted_p_value, effect_size) per group and bin kept.

    Bins are kept within ``ranges`` of their start (closed, bounds in any order) and, if given, in ``peak_bins`` (bin_index). Both classes must
    occur, else it is an error; with ``by``, groups without one of the classes are left out.
    """
    by = list(by)
    if not by:
        seen = {r[0] for r in matrix.where("y in (0, 1)").select("y").distinct().collect()}
        if len(seen) < 2:
            raise ValueError("both classes must occur")
    if ranges is not None:
        matrix = matrix.where(reduce(lambda a, b: a | b, [F.col(start).between(min(r), max(r)) for r in ranges]))
    if peak_bins is not None:
        matrix = matrix.join(peak_bins.select("bin_index").distinct(), "bin_index", "left_semi")
    m = with_fold_change(class_moments(matrix, by).where("n_r > 0 and n_s > 0"), by).withColumn("effect_size", effect_size())
    if test == "mann_whitney":
        m = m.join(rank_sums(matrix, by).select(*by, "bin_index", rank_sum_p().alias("p_value")), [*by, "bin_index"])
    elif test == "t_test":
        m = welch(m).withColumn("p_value", stats.student("t", "df"))
    else:
        raise ValueError(f"unknown test {test}")
    return corrected(m, method=correction, by=by).select(*by, "bin_index", "mean_r", "mean_s", "fold_change", "p_value", "adjusted_p_value", "effect_size")


def top(results: DataFrame, n: int = 20) -> DataFrame:
    """The n smallest adjusted p, ties in order of bins."""
    return results.orderBy("adjusted_p_value", "bin_index").limit(n)


def significant(results: DataFrame, fold: float = 1.0, p: float = 0.05) -> DataFrame:
    return results.where((F.abs("fold_change") >= fold) & (F.col("adjusted_p_value") <= p))


def compared(results: DataFrame, drugs: list[str], drug: str = "drug", fold: float = 1.0, p: float = 0.05) -> DataFrame:
    """Bin x drug flags over the bins significant for any of the named drugs."""
    s = significant(results, fold, p).where(F.col(drug).isin(drugs))
    return s.groupBy("bin_index").agg(*[F.max((F.col(drug) == d)).alias(d) for d in drugs])


def volcano(results: DataFrame, fold: float = 1.0, p: float = 0.05) -> DataFrame:
    """Plot data: class up_R, up_S or NS (strictly beyond the fold threshold) and -log10 of p, kept off 0."""
    hit = F.col("adjusted_p_value") <= p
    kind = F.when(hit & (F.col("fold_change") > fold), "up_R").when(hit & (F.col("fold_change") < -fold), "up_S").otherwise("NS")
    return results.select("bin_index", "fold_change", (-F.log10(F.least(F.greatest("adjusted_p_value", F.lit(1e-300)), F.lit(1.0)))).alias("neg_log10_p"), kind.alias("kind"))


def flag_sets(flags: DataFrame, drugs: list[str]) -> DataFrame:
    """(flags..., n): how often each combination of drugs occurs, the empty one left out, most frequent first."""
    some = reduce(lambda a, b: a | b, [F.col(d) for d in drugs])
    return flags.where(some).groupBy(*drugs).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *drugs)

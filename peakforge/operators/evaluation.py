"""Reports on predicted categories and MICs, and stratified or grouped splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakforge.functions.numbers import with_ranges


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.try_divide(part, whole)).otherwise(0.0)


def confusion(truth: Column, guess: Column) -> dict[str, Column]:
    """Counts over rows where both are known; 1 is resistant."""
    n = lambda t, g: F.count_if((truth == t) & (guess == g))
    return {"tp": n(1, 1), "fn": n(1, 0), "fp": n(0, 1), "tn": n(0, 0)}


def report(rows: DataFrame, truth: str = "y_true", guess: str = "y_pred", by: list[str] = ()) -> DataFrame:
    """Very major and major error rates, sensitivity, specificity, agreement and counts, per group of ``by``; empty classes rate 0."""
    t, g = F.col(truth), F.col(guess)
    c = rows.where(t.isNotNull() & g.isNotNull()).groupBy(*by).agg(*[v.alias(k) for k, v in confusion(t, g).items()], F.coalesce(F.avg((t == g).cast("double")), F.lit(0.0)).alias("agreement"))
    tp, fn, fp, tn = (F.col(k) for k in ("tp", "fn", "fp", "tn"))
    return c.select(
        *by, _rate(fn, fn + tp).alias("vme"), _rate(fp, fp + tn).alias("me"), _rate(tp, fn + tp).alias("sensitivity"), _rate(tn, fp + tn).alias("specificity"),
        "agreement", (tp + fn).alias("n_resistant"), (fp + tn).alias("n_susceptible"), (tp + fn + fp + tn).alias("n"),
    )


def multilabel_report(rows: DataFrame, drug: str = "drug", truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """One row per drug and a row ``macro_avg``: mean rates and summed counts."""
    per = report(rows, truth, guess, [drug])
    rates, counts = ["vme", "me", "sensitivity", "specificity", "agreement"], ["n_resistant", "n_susceptible", "n"]
    macro = per.agg(*[F.avg(r).alias(r) for r in rates], *[F.sum(c).alias(c) for c in counts]).select(F.lit("macro_avg").alias(drug), *rates, *counts)
    return per.unionByName(macro)


def error_curve(rows: DataFrame, truth: str = "y_true", score: str = "score") -> DataFrame:
    """(threshold, vme, me) at every distinct score, resistant being called from the threshold up.

    Rows are counted per score before the running sums, which are taken in score ranges first, so that no task holds all scores.
    """
    per = rows.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(truth) == 1).alias("r"), F.count_if(F.col(truth) == 0).alias("s")
    )
    per = with_ranges(per, "threshold", out="b")
    inner = Window.partitionBy("b").orderBy("threshold").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = per.groupBy("b").agg(F.sum("r").alias("rb"), F.sum("s").alias("sb"))
    ranges = ranges.select("b", F.coalesce(F.sum("rb").over(outer), F.lit(0)).alias("r0"), F.coalesce(F.sum("sb").over(outer), F.lit(0)).alias("s0"), F.sum("rb").over(Window.partitionBy()).alias("rn"), F.sum("sb").over(Window.partitionBy()).alias("sn"))
    run = per.withColumn("r1", F.coalesce(F.sum("r").over(inner), F.lit(0))).withColumn("s1", F.coalesce(F.sum("s").over(inner), F.lit(0))).join(ranges, "b")
    return run.select("threshold", _rate(F.col("r0") + F.col("r1"), F.col("rn")).alias("vme"), _rate(F.col("sn") - F.col("s0") - F.col("s1"), F.col("sn")).alias("me"))


def mic_report(rows: DataFrame, truth: str = "log2_true", guess: str = "log2_pred", weight: str | None = None, by: list[str] = ()) -> DataFrame:
    """n, weighted rmse, mae, bias and essential agreement (within one dilution) of log2 MICs; nulls and NaN are left out."""
    t, g = F.col(truth), F.col(guess)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    ok = rows.where(t.isNotNull() & g.isNotNull() & ~F.isnan(t) & ~F.isnan(g)).withColumn("_w", w).withColumn("_d", g - t)
    avg = lambda c: F.try_divide(F.sum(F.col("_w") * c), F.sum("_w"))
    d = F.col("_d")
    return ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sqrt(avg(d * d)).alias("rmse"), avg(F.abs(d)).alias("mae"), avg(d).alias("bias"), avg((F.abs(d) <= 1).cast("double")).alias("essential_agreement"))


def category_block(rows: DataFrame, truth: str = "category_true", guess: str = "category_pred", by: list[str] = ()) -> DataFrame:
    """Agreement, very major (R called S) and major (S called R) errors; null where a class is empty."""
    t, g = F.col(truth), F.col(guess)
    share = lambda a, b: F.avg(F.when(t == a, (g == b).cast("double")))
    return rows.where(t.isNotNull() & g.isNotNull()).groupBy(*by).agg(F.avg((t == g).cast("double")).alias("agreement"), share("R", "S").alias("vme"), share("S", "R").alias("me"), F.count(F.lit(1)).alias("n"))


def strata(rows: DataFrame, species: str, label: str, min_count: int = 2) -> DataFrame:
    """Adds ``stratum``: species and label, rare ones merged per label."""
    name = F.concat(F.coalesce(F.col(species), F.lit("null")), F.lit("__"), F.col(label).cast("string"))
    n = F.count(F.lit(1)).over(Window.partitionBy(species, label))
    return rows.withColumn("stratum", F.when(n < min_count, F.concat(F.lit("__rare_"), F.col(label).cast("string"), F.lit("__"))).otherwise(name))


def stratified_split(rows: DataFrame, key: str, stratum: str = "stratum", test_share: float = 0.2, seed: int = 0) -> DataFrame:
    """Adds ``is_test``: in every stratum the rows with the smallest keyed hashes, rounded to the share."""
    w = Window.partitionBy(stratum)
    r = F.row_number().over(w.orderBy(F.xxhash64(key, F.lit(seed)), key))
    return rows.withColumn("is_test", r <= F.round(F.count(F.lit(1)).over(w) * F.lit(test_share)))


def group_split(rows: DataFrame, group: str, test_share: float = 0.2, seed: int = 0) -> DataFrame:
    """Adds ``is_test`` by a hash of the group, so no group is divided; null groups are divided by nothing and count as one."""
    h = F.pmod(F.xxhash64(group, F.lit(seed)), F.lit(1_000_000))
    return rows.withColumn("is_test", h < F.lit(int(test_share * 1_000_000)))


def stratified_folds(rows: DataFrame, key: str, stratum: str = "stratum", k: int = 5) -> DataFrame:
    """Adds ``fold``: the rows of each stratum dealt out in order of the key."""
    r = F.row_number().over(Window.partitionBy(stratum).orderBy(key))
    return rows.withColumn("fold", ((r - 1) % k).cast("int"))


def grouped_folds(rows: DataFrame, group: str, label: str, k: int = 5) -> DataFrame:
    """Adds ``fold``: whole groups, dealt out in descending size within each majority label, forwards and backwards in turn."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col(label).cast("int")), F.lit(0)).alias("p"))
    sizes = sizes.withColumn("kind", (F.col("p") * 2 > F.col("n")).cast("int"))
    r = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), group)) - 1
    turn = F.floor(r / k).cast("int")
    fold = F.when(turn % 2 == 0, r % k).otherwise(k - 1 - r % k)
    return rows.join(sizes.withColumn("fold", fold.cast("int")).select(F.col(group).alias("_g"), "fold"), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")

"""Queries on records and cohorts: filters, duplicates, susceptibility, evaluation, statistics, similarity, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakforge.operators import differential, drift, evaluation, filters, plots, replicates, similarity, susceptibility
from peakforge.plans.registry import Registry
from peakforge.plans.views import MIC, RESISTANT_ABOVE, START, WIDTH, labels, matrix, peaks, records, rounded, spectra, sql
from peakforge.sources.tables import table

R = Registry()


def _meta(spark, d):
    return table(spark, d, "metadata")


# filters


@R.add(
    "filter_and_or_not",
    sql("SELECT row_no, species, drug FROM metadata WHERE (coalesce(species IN ('Nublavibrio kimianii', 'Takimonas braroosum'), false) OR coalesce(mic IN ('1', '2'), false)) AND NOT coalesce(drug = 'Vocillin', false)"),
)
def filter_and_or_not(spark, d):
    rule = (filters.species(["Nublavibrio kimianii", "Takimonas braroosum"]) | filters.drug("mic", ["1", "2"])) & ~filters.metadata("drug", lambda c: c == "Vocillin")
    return filters.apply(_meta(spark, d), rule).select("row_no", "species", "drug")


@R.add("filter_quality", sql("SELECT row_no, snr, n_peaks, baseline_fraction FROM metadata WHERE snr >= 10 AND n_peaks >= 60 AND baseline_fraction <= 0.8"))
def filter_quality(spark, d):
    return filters.apply(_meta(spark, d), filters.quality(10, 60, 0.8)).select("row_no", "snr", "n_peaks", "baseline_fraction")


@R.add("filter_drug", sql("SELECT row_no, drug, mic FROM metadata WHERE mic IS NOT NULL"))
def filter_drug(spark, d):
    return filters.apply(_meta(spark, d), filters.drug("mic")).select("row_no", "drug", "mic")


@R.add(
    "feature_matrix",
    sql("SELECT spectrum_no, bin_index, intensity, r.species, r.mic FROM matrix JOIN records r USING (id) WHERE r.mic IS NOT NULL AND r.species = 'Nublavibrio kimianii'"),
)
def feature_matrix(spark, d):
    """No rows where the species is missing, as in SQL; a ``SpectrumSet`` of a missing species is an error."""
    kept = filters.any_drug(filters.apply(records(spark, d), filters.species("Nublavibrio kimianii")), ["mic"]).select("id", "species", "mic")
    return spectra(spark, d).select("spectrum_no", "id", "x").join(kept, "id").select("spectrum_no", F.posexplode("x").alias("bin_index", "intensity"), "species", "mic")


@R.add("isolate_groups", sql(r"SELECT regexp_replace(id, '_MALDI\d+$', '') AS isolate, count(*) AS n_rows, count(DISTINCT id) AS n_ids FROM metadata GROUP BY 1"))
def isolate_groups(spark, d):
    return _meta(spark, d).groupBy(replicates.isolate_key(F.col("id")).alias("isolate")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids"))


# duplicates and replicates


def _dup(strategy):
    def run(spark, d):
        return replicates.resolve_duplicates(_meta(spark, d).select("row_no", "id", "drug"), "id", ["row_no"], strategy)

    return run


R.add("dup_first", "SELECT row_no, id, drug FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_no) AS k FROM metadata) WHERE k = 1")(_dup("first"))
R.add("dup_last", "SELECT row_no, id, drug FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_no DESC) AS k FROM metadata) WHERE k = 1")(_dup("last"))
R.add("dup_drop", "SELECT row_no, id, drug FROM (SELECT *, count(*) OVER (PARTITION BY id) AS k FROM metadata) WHERE k = 1")(_dup("drop"))
R.add(
    "dup_keep_all",
    """SELECT row_no, id, drug FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_no) AS j FROM
 (SELECT row_no, drug, id || '_rep' || row_number() OVER (PARTITION BY id ORDER BY row_no) AS id FROM metadata)) WHERE j = 1""",
)(_dup("keep_all"))
R.add("dup_average", "SELECT row_no, id, drug, id AS _original_id FROM metadata")(_dup("average"))

_BY = "SELECT instrument, bin_index, {} AS intensity FROM matrix {} GROUP BY 1, 2"


@R.add("merge_mean", sql(_BY.format("avg(intensity)", ""), "intensity"))
def merge_mean(spark, d):
    return rounded(replicates.merge(matrix(spark, d, "instrument"), "instrument"))


@R.add("merge_weighted", sql(_BY.format("sum(intensity * w) / sum(w)", "JOIN (SELECT id, snr AS w FROM records WHERE snr > 0) USING (id)"), "intensity"))
def merge_weighted(spark, d):
    w = records(spark, d).where("snr > 0").select("id", F.col("snr").alias("w"))
    s = spectra(spark, d).join(w, "id").select("instrument", "w", F.posexplode("x").alias("bin_index", "intensity"))
    return rounded(replicates.merge(s, "instrument", how="weighted", weight="w"))


@R.add("merge_median", sql(_BY.format("median(intensity)", ""), "intensity"))
def merge_median(spark, d):
    return rounded(replicates.merge(matrix(spark, d, "instrument"), "instrument", how="median"))


@R.add("merge_grids")
def merge_grids(spark, d):
    keyed = peaks(spark, d).join(table(spark, d, "maldiset", "spectrum_no", "id"), "spectrum_no").where("id is not null")
    out = replicates.merge_grids(keyed.select(F.lower(F.trim(replicates.isolate_key(F.col("id")))).alias("isolate"), "mz", "intensity"), "isolate")
    return rounded(out.select("isolate", F.posexplode(F.arrays_zip("mz", "intensity")).alias("pos", "p")).select("isolate", "pos", "p.mz", "p.intensity"))


_OUT = """centre AS (SELECT instrument, bin_index, median(intensity) AS c FROM matrix GROUP BY 1, 2),
r AS (SELECT instrument, spectrum_no, CASE WHEN stddev_pop(intensity) * stddev_pop(c) > 0 THEN covar_pop(intensity, c) / (stddev_pop(intensity) * stddev_pop(c)) ELSE 0 END AS correlation FROM matrix JOIN centre USING (instrument, bin_index) GROUP BY 1, 2),
m AS (SELECT instrument, median(correlation) AS m, count(*) AS n FROM r GROUP BY 1),
dev AS (SELECT instrument, m, n, median(abs(correlation - m)) AS dd FROM r JOIN m USING (instrument) GROUP BY 1, 2, 3)"""


@R.add("replicate_outliers", sql("SELECT instrument, spectrum_no, correlation, dd = 0 OR n < 3 OR correlation >= greatest(m - 3 * 1.4826 * dd, -1) AS keep FROM r JOIN dev USING (instrument)", "correlation", ctes=_OUT))
def replicate_outliers(spark, d):
    return rounded(replicates.outlier_replicates(matrix(spark, d, "instrument").where("instrument is not null"), "instrument", "spectrum_no"))


# susceptibility


@R.add("mic_parse", sql(f"SELECT row_no, mic_value, CASE WHEN mic_value IS NULL THEN '' WHEN regexp_extract(mic, {MIC}, 1) = '' THEN '=' ELSE regexp_extract(mic, {MIC}, 1) END AS qualifier FROM mics"))
def mic_parse(spark, d):
    return _meta(spark, d).select("row_no", susceptibility.mic_value(F.col("mic")).alias("mic_value"), susceptibility.mic_qualifier(F.col("mic")).alias("qualifier"))


_LIMITS = """limits AS (SELECT * FROM (SELECT *, lower(trim(species, ' ')) AS sk, lower(trim(drug, ' ')) AS dk, row_number() OVER (PARTITION BY lower(trim(species, ' ')), lower(trim(drug, ' ')) ORDER BY row_no DESC) AS k
 FROM breakpoint_table WHERE species IS NOT NULL AND drug IS NOT NULL) WHERE k = 1),
cats AS (SELECT m.row_no, m.species, m.drug, mic, mic_value, sk, l.source, CASE WHEN mic_value <= s_le THEN 'S' WHEN mic_value > r_gt THEN 'R' WHEN mic_value IS NOT NULL AND s_le IS NOT NULL THEN 'I' END AS category,
 coalesce(CASE WHEN atu_low IS NULL THEN false WHEN atu_high IS NULL THEN mic_value = atu_low ELSE mic_value BETWEEN atu_low AND atu_high END, false) AS in_atu
 FROM mics m LEFT JOIN limits l ON lower(trim(m.species, ' ')) = sk AND lower(trim(m.drug, ' ')) = dk)"""


def _categories(spark, d):
    rows = _meta(spark, d).select("row_no", "id", "species", "drug", "mic")
    return susceptibility.encoded(rows, table(spark, d, "breakpoint_table"))


@R.add("breakpoint_apply", sql("SELECT row_no, category, CASE WHEN sk IS NOT NULL THEN in_atu END AS atu, source FROM cats", ctes=_LIMITS))
def breakpoint_apply(spark, d):
    return _categories(spark, d).select("row_no", "category", "atu", "source")


@R.add(
    "mic_encode",
    sql(f"SELECT row_no, CASE WHEN mic_value > 0 THEN log2(mic_value) END AS log2_mic, mic_value IS NOT NULL AND regexp_extract(mic, {MIC}, 1) IN ('<', '<=', '>', '>=') AS censored, category FROM cats", "log2_mic", ctes=_LIMITS),
)
def mic_encode(spark, d):
    return rounded(_categories(spark, d).select("row_no", "log2_mic", "censored", "category"))


@R.add("label_encode", sql("SELECT row_no, CAST(CASE category WHEN 'R' THEN 1 WHEN 'S' THEN 0 WHEN 'I' THEN 0 END AS INTEGER) AS label FROM cats WHERE category IS NOT NULL", ctes=_LIMITS))
def label_encode(spark, d):
    return susceptibility.labelled(_categories(spark, d).where("category is not null"), "category").select("row_no", "label")


@R.add("breakpoint_species", "SELECT DISTINCT version, species FROM breakpoint_table WHERE species IS NOT NULL")
def breakpoint_species(spark, d):
    return table(spark, d, "breakpoint_table", "version", "species").where("species is not null").distinct()


# evaluation: the category by breakpoints as truth, a fixed MIC limit as prediction

_EVAL = _LIMITS + f", ev AS (SELECT row_no, drug, species, CAST(category = 'R' AS INTEGER) AS y_true, CAST(mic_value > {RESISTANT_ABOVE} AS INTEGER) AS y_pred, mic_value, category FROM cats WHERE category IN ('R', 'S'))"
_RATES = """sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1 ELSE 0 END) AS fn,
 sum(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1 ELSE 0 END) AS tn, avg(CAST(y_true = y_pred AS DOUBLE)) AS agreement"""
_SHOWN = """CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0 END AS vme, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS me, CASE WHEN fn + tp > 0 THEN tp / (fn + tp) ELSE 0 END AS sensitivity,
 CASE WHEN fp + tn > 0 THEN tn / (fp + tn) ELSE 0 END AS specificity, agreement, CAST(tp + fn AS BIGINT) AS n_resistant, CAST(fp + tn AS BIGINT) AS n_susceptible, CAST(tp + fn + fp + tn AS BIGINT) AS n"""
_R5 = ("vme", "me", "sensitivity", "specificity", "agreement")


def _evaluated(spark, d):
    rows = _categories(spark, d).where("category in ('R', 'S')")
    return rows.select("row_no", "drug", "species", (F.col("category") == "R").cast("int").alias("y_true"), (F.col("mic_value") > RESISTANT_ABOVE).cast("int").alias("y_pred"), "mic_value", "category")


@R.add("amr_report", sql(f"SELECT {_SHOWN} FROM (SELECT {_RATES} FROM ev)", *_R5, ctes=_EVAL))
def amr_report(spark, d):
    return rounded(evaluation.report(_evaluated(spark, d)))


@R.add(
    "amr_multilabel",
    sql(
        "SELECT * FROM per UNION ALL SELECT 'macro_avg', avg(vme), avg(me), avg(sensitivity), avg(specificity), avg(agreement), CAST(sum(n_resistant) AS BIGINT), CAST(sum(n_susceptible) AS BIGINT), CAST(sum(n) AS BIGINT) FROM per",
        *_R5, ctes=_EVAL + f", per AS (SELECT drug, {_SHOWN} FROM (SELECT drug, {_RATES} FROM ev GROUP BY drug))",
    ),
)
def amr_multilabel(spark, d):
    return rounded(evaluation.multilabel_report(_evaluated(spark, d)))


_CURVE = """sc AS (SELECT y, snr AS score FROM labels JOIN maldiset USING (spectrum_no) JOIN records USING (id) WHERE snr IS NOT NULL),
per AS (SELECT score AS threshold, sum(y) AS r, sum(1 - y) AS s FROM sc GROUP BY 1),
run AS (SELECT threshold, coalesce(sum(r) OVER w, 0) AS rb, coalesce(sum(s) OVER w, 0) AS sb, sum(r) OVER () AS rn, sum(s) OVER () AS sn FROM per WINDOW w AS (ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@R.add("vme_me_curve", sql("SELECT threshold, CASE WHEN rn > 0 THEN rb / rn ELSE 0 END AS vme, CASE WHEN sn > 0 THEN (sn - sb) / sn ELSE 0 END AS me FROM run", "vme", "me", ctes=_CURVE))
def vme_me_curve(spark, d):
    snr = records(spark, d).where("snr is not null").select("id", F.col("snr").alias("score"))
    s = table(spark, d, "maldiset", "spectrum_no", "id").join(snr, "id").join(labels(spark, d), "spectrum_no")
    return rounded(evaluation.error_curve(s.select(F.col("y").alias("y_true"), "score")))


_REG = "reg AS (SELECT drug, log2(mic_value) AS t, log2(mic_value) + (n_peaks % 5 - 2) AS g, snr AS w FROM mics WHERE mic_value > 0 AND n_peaks IS NOT NULL AND snr IS NOT NULL)"


@R.add(
    "mic_regression",
    sql("SELECT drug, count(*) AS n, sqrt(sum(w * (g - t) ** 2) / sum(w)) AS rmse, sum(w * abs(g - t)) / sum(w) AS mae, sum(w * (g - t)) / sum(w) AS bias, sum(w * CASE WHEN abs(g - t) <= 1 THEN 1 ELSE 0 END) / sum(w) AS essential_agreement FROM reg GROUP BY 1",
        "rmse", "mae", "bias", "essential_agreement", ctes=_REG),
)
def mic_regression(spark, d):
    r = _meta(spark, d).withColumn("v", susceptibility.mic_value(F.col("mic"))).where("v > 0 and n_peaks is not null and snr is not null")
    r = r.select("drug", F.log2("v").alias("t"), (F.log2("v") + (F.col("n_peaks") % 5 - 2)).alias("g"), F.col("snr").alias("w"))
    return rounded(evaluation.mic_report(r, "t", "g", "w", ["drug"]))


_CAT = _LIMITS + ", ev AS (SELECT drug, category AS t, CASE WHEN mic_value <= 1 THEN 'S' WHEN mic_value > 8 THEN 'R' ELSE 'I' END AS g FROM cats WHERE category IS NOT NULL)"


@R.add(
    "category_block",
    sql("SELECT drug, avg(CAST(t = g AS DOUBLE)) AS agreement, avg(CASE WHEN t = 'R' THEN CAST(g = 'S' AS DOUBLE) END) AS vme, avg(CASE WHEN t = 'S' THEN CAST(g = 'R' AS DOUBLE) END) AS me, count(*) AS n FROM ev GROUP BY 1", "agreement", "vme", "me", ctes=_CAT),
)
def category_block(spark, d):
    guess = F.when(F.col("mic_value") <= 1, "S").when(F.col("mic_value") > 8, "R").otherwise("I")
    return rounded(evaluation.category_block(_categories(spark, d).where("category is not null").withColumn("g", guess), "category", "g", ["drug"]))


_STRATA = """st AS (SELECT row_no, CASE WHEN count(*) OVER (PARTITION BY species, label) < 5 THEN '__rare_' || label || '__' ELSE coalesce(species, 'null') || '__' || label END AS stratum
 FROM (SELECT row_no, species, CASE category WHEN 'R' THEN 1 ELSE 0 END AS label FROM cats WHERE category IS NOT NULL))"""


def _strata(spark, d):
    return evaluation.strata(susceptibility.labelled(_categories(spark, d).where("category is not null"), "category"), "species", "label", 5)


@R.add("strata", sql("SELECT row_no, stratum FROM st", ctes=_LIMITS + ", " + _STRATA))
def strata(spark, d):
    return _strata(spark, d).select("row_no", "stratum")


@R.add("stratified_kfold", sql("SELECT row_no, CAST((row_number() OVER (PARTITION BY stratum ORDER BY row_no) - 1) % 5 AS INTEGER) AS fold FROM st", ctes=_LIMITS + ", " + _STRATA))
def stratified_kfold(spark, d):
    return evaluation.stratified_folds(_strata(spark, d), "row_no").select("row_no", "fold")


_GROUPS = """g AS (SELECT batch_id, count(*) AS n, sum(CASE WHEN snr > 20 THEN 1 ELSE 0 END) AS p FROM metadata GROUP BY 1),
o AS (SELECT batch_id, row_number() OVER (PARTITION BY CAST(p * 2 > n AS INTEGER) ORDER BY n DESC, batch_id NULLS FIRST) - 1 AS r FROM g),
f AS (SELECT batch_id, CAST(CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS INTEGER) AS fold FROM o)"""


@R.add("group_kfold", sql("SELECT row_no, fold FROM metadata m JOIN f ON m.batch_id IS NOT DISTINCT FROM f.batch_id", ctes=_GROUPS))
def group_kfold(spark, d):
    rows = _meta(spark, d).select("row_no", "batch_id", F.when(F.col("snr") > 20, 1).otherwise(0).alias("label"))
    return evaluation.grouped_folds(rows, "batch_id", "label", 5).select("row_no", "fold")


@R.add("stratified_split")
def stratified_split(spark, d):
    return evaluation.stratified_split(_strata(spark, d), "row_no").select("row_no", "stratum", "is_test")


@R.add("group_split")
def group_split(spark, d):
    return evaluation.group_split(_meta(spark, d).select("row_no", "case_id"), "case_id")


# differential analysis

_LAB = "lab AS (SELECT m.*, y FROM matrix m JOIN labels USING (spectrum_no))"
_MOM = _LAB + """, mom AS (SELECT bin_index, count(*) FILTER (y = 1) AS n_r, count(*) FILTER (y = 0) AS n_s, avg(intensity) FILTER (y = 1) AS mean_r, avg(intensity) FILTER (y = 0) AS mean_s,
 var_samp(intensity) FILTER (y = 1) AS var_r, var_samp(intensity) FILTER (y = 0) AS var_s FROM lab GROUP BY 1),
lev AS (SELECT greatest(median(abs(mean_r) + abs(mean_s)) * 1e-3, 1e-12) AS e FROM mom),
diff AS (SELECT mom.*, log2((mean_r + e) / (mean_s + e)) AS fold_change, CASE WHEN n_r < 2 OR n_s < 2 OR NOT ((n_r - 1) * var_r + (n_s - 1) * var_s) / (n_r + n_s - 2) > 0 THEN 0
 ELSE (mean_r - mean_s) / sqrt(((n_r - 1) * var_r + (n_s - 1) * var_s) / (n_r + n_s - 2)) END AS effect_size FROM mom, lev)"""


def _labelled(spark, d, *more):
    return spectra(spark, d).select("spectrum_no", *more, "x").join(labels(spark, d), "spectrum_no").select("spectrum_no", *more, "y", F.posexplode("x").alias("bin_index", "intensity"))


@R.add("diff_means_fc_d", sql("SELECT bin_index, mean_r, mean_s, fold_change, effect_size FROM diff", "mean_r", "mean_s", "fold_change", "effect_size", ctes=_MOM))
def diff_means_fc_d(spark, d):
    m = differential.with_fold_change(differential.class_moments(_labelled(spark, d))).withColumn("effect_size", differential.effect_size())
    return rounded(m.select("bin_index", "mean_r", "mean_s", "fold_change", "effect_size"))


_U = _LAB + """, ranked AS (SELECT bin_index, y, rank() OVER (PARTITION BY bin_index ORDER BY intensity) + (count(*) OVER (PARTITION BY bin_index, intensity) - 1) / 2.0 AS rk, intensity FROM lab),
ties AS (SELECT bin_index, sum(t ** 3 - t) AS ties FROM (SELECT bin_index, CAST(count(*) AS DOUBLE) AS t FROM lab GROUP BY bin_index, intensity) GROUP BY 1)"""


@R.add("diff_mwu_stat", sql("SELECT bin_index, count(*) FILTER (y = 1) AS n_r, count(*) FILTER (y = 0) AS n_s, sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2 AS u, any_value(ties) AS ties FROM ranked JOIN ties USING (bin_index) GROUP BY 1", ctes=_U))
def diff_mwu_stat(spark, d):
    return differential.rank_sums(_labelled(spark, d))


@R.add(
    "diff_welch_t",
    sql("SELECT bin_index, (mean_r - mean_s) / sqrt(var_r / n_r + var_s / n_s) AS t, (var_r / n_r + var_s / n_s) ** 2 / ((var_r / n_r) ** 2 / (n_r - 1) + (var_s / n_s) ** 2 / (n_s - 1)) AS df FROM mom", "t", "df", ctes=_MOM, digits=4),
)
def diff_welch_t(spark, d):
    return rounded(differential.welch(differential.class_moments(_labelled(spark, d))).select("bin_index", "t", "df"), 4)


def _results(spark, d, test="mann_whitney"):
    return differential.analysis(_labelled(spark, d), test)


@R.add("diff_analysis")
def diff_analysis(spark, d):
    return rounded(_results(spark, d))


@R.add("diff_analysis_t")
def diff_analysis_t(spark, d):
    return rounded(_results(spark, d, "t_test"))


@R.add("diff_top")
def diff_top(spark, d):
    return rounded(differential.top(_results(spark, d), 20))


@R.add("diff_significant")
def diff_significant(spark, d):
    return rounded(differential.significant(_results(spark, d), 0.05, 0.5))


@R.add("volcano_data")
def volcano_data(spark, d):
    return rounded(differential.volcano(_results(spark, d), 0.05, 0.5))


_P = "pv AS (SELECT bin_index, CASE WHEN bin_index % 17 = 0 THEN NULL ELSE least(1, 1 / (1 + 50 * abs(effect_size))) END AS p_value FROM diff), kn AS (SELECT *, count(p_value) OVER () AS m, row_number() OVER (ORDER BY p_value NULLS LAST, bin_index) AS k FROM pv)"
_H = "sum(CASE WHEN k <= m THEN 1.0 / k END) OVER ()"


@R.add(
    "bh_by_bonferroni",
    sql(
        f"""SELECT bin_index, CASE WHEN p_value IS NULL THEN 1 ELSE least(1, min(p_value * m / k) OVER w) END AS bh, CASE WHEN p_value IS NULL THEN 1 ELSE least(1, min(p_value * m / k * h) OVER w) END AS by_, CASE WHEN p_value IS NULL THEN 1 ELSE least(1, p_value * m) END AS bonferroni
FROM (SELECT *, {_H} AS h FROM kn) WINDOW w AS (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
        "bh", "by_", "bonferroni", ctes=_MOM + ", " + _P,
    ),
)
def bh_by_bonferroni(spark, d):
    m = differential.class_moments(_labelled(spark, d)).withColumn("e", differential.effect_size())
    p = m.select("bin_index", F.when(F.col("bin_index") % 17 != 0, F.least(F.lit(1.0), 1 / (1 + 50 * F.abs("e")))).alias("p_value"))
    for method, name in (("fdr_bh", "bh"), ("fdr_by", "by_"), ("bonferroni", "bonferroni")):
        p = differential.corrected(p, method=method, out=name)
    return rounded(p.select("bin_index", "bh", "by_", "bonferroni"))


_DRUGS = ["Vocillin", "Nubveroxime", "Mifencyclin"]
_PER = """ld AS (SELECT drug, bin_index, intensity, CAST(v > 4 AS INTEGER) AS y FROM matrix JOIN (SELECT id, drug, CAST(replace(regexp_extract(mic, """ + MIC + """, 2), ',', '.') AS DOUBLE) AS v FROM records WHERE regexp_matches(mic, """ + MIC + """) AND drug IN ('Vocillin', 'Nubveroxime', 'Mifencyclin')) USING (id)),
md AS (SELECT drug, bin_index, count(*) FILTER (y = 1) AS n_r, count(*) FILTER (y = 0) AS n_s, avg(intensity) FILTER (y = 1) AS mr, avg(intensity) FILTER (y = 0) AS ms, var_samp(intensity) FILTER (y = 1) AS vr, var_samp(intensity) FILTER (y = 0) AS vs FROM ld GROUP BY 1, 2),
fl AS (SELECT bin_index, drug, abs(round(CASE WHEN n_r < 2 OR n_s < 2 OR NOT ((n_r - 1) * vr + (n_s - 1) * vs) / (n_r + n_s - 2) > 0 THEN 0 ELSE (mr - ms) / sqrt(((n_r - 1) * vr + (n_s - 1) * vs) / (n_r + n_s - 2)) END, 9)) >= 0.5 AS hit FROM md),
fg AS (SELECT bin_index, bool_or(drug = 'Vocillin') AS "Vocillin", bool_or(drug = 'Nubveroxime') AS "Nubveroxime", bool_or(drug = 'Mifencyclin') AS "Mifencyclin" FROM fl WHERE hit GROUP BY 1)"""


def _flags(spark, d):
    r = records(spark, d).where(F.col("drug").isin(_DRUGS)).select("id", "drug", susceptibility.mic_value(F.col("mic")).alias("v")).where("v is not null")
    m = spectra(spark, d).join(r, "id").select("drug", (F.col("v") > 4).cast("int").alias("y"), F.posexplode("x").alias("bin_index", "intensity"))
    e = differential.class_moments(m, ["drug"]).select("drug", "bin_index", F.round(differential.effect_size(), 9).alias("fold_change"), F.lit(0.0).alias("adjusted_p_value"))
    return differential.compared(e, _DRUGS, fold=0.5)


@R.add("compare_drugs", sql("SELECT * FROM fg", ctes=_PER))
def compare_drugs(spark, d):
    return _flags(spark, d)


@R.add("upset_counts", sql('SELECT "Vocillin", "Nubveroxime", "Mifencyclin", count(*) AS n FROM fg GROUP BY 1, 2, 3', ctes=_PER))
def upset_counts(spark, d):
    return differential.flag_sets(_flags(spark, d), _DRUGS)


@R.add("manhattan_data", sql("SELECT bin_index, CAST(2000 + 75 * bin_index AS DOUBLE) AS mz, effect_size FROM diff", "effect_size", ctes=_MOM))
def manhattan_data(spark, d):
    m = differential.class_moments(_labelled(spark, d))
    return rounded(m.select("bin_index", (F.col("bin_index") * F.lit(WIDTH) + START).alias("mz"), differential.effect_size().alias("effect_size")))


@R.add("pseudogel_rank", sql("SELECT spectrum_no, instrument, row_number() OVER (PARTITION BY instrument ORDER BY round(m, 9) DESC, spectrum_no) AS place, ln(1 + m) AS shade FROM (SELECT spectrum_no, instrument, avg(intensity) AS m FROM matrix GROUP BY 1, 2)", "shade"))
def pseudogel_rank(spark, d):
    from pyspark.sql import Window

    m = matrix(spark, d, "instrument").groupBy("spectrum_no", "instrument").agg(F.avg("intensity").alias("m"))
    w = Window.partitionBy("instrument").orderBy(F.desc(F.round("m", 9)), "spectrum_no")
    return rounded(m.select("spectrum_no", "instrument", F.row_number().over(w).cast("bigint").alias("place"), F.log1p("m").alias("shade")))


# similarity: every fiftieth embedding as query against all


_DOT = "list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(o.embedding AS DOUBLE[])), lambda p: p[1] * p[2]))"
_NQ = "sqrt(list_sum(list_transform(CAST(q.embedding AS DOUBLE[]), lambda v: v * v)))"
_NO = "sqrt(list_sum(list_transform(CAST(o.embedding AS DOUBLE[]), lambda v: v * v)))"
_PAIR = "FROM embeddings q JOIN embeddings o ON q.vec_id % 50 = 0 AND q.vec_id <> o.vec_id"


def _distance(metric):
    def run(spark, d):
        e = table(spark, d, "embeddings", "vec_id", "embedding")
        return rounded(similarity.query_distances(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", metric))

    return run


R.add("query_cosine", sql(f"SELECT q.vec_id AS i, o.vec_id AS j, 1 - {_DOT} / ({_NQ} * {_NO}) AS distance {_PAIR}", "distance"))(_distance("cosine"))
R.add("query_angle", sql(f"SELECT q.vec_id AS i, o.vec_id AS j, acos(greatest(-1, least(1, {_DOT} / ({_NQ} * {_NO})))) * 2 / pi() AS distance {_PAIR}", "distance"))(_distance("angle"))
R.add(
    "query_pearson",
    sql("SELECT q.vec_id AS i, o.vec_id AS j, 1 - corr(q.v, o.v) AS distance FROM e q JOIN e o ON q.k = o.k AND q.vec_id % 50 = 0 AND q.vec_id <> o.vec_id GROUP BY 1, 2", "distance", ctes="e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"),
)(_distance("pearson"))

_SIL = f"""dq AS (SELECT q.vec_id AS i, q.label, o.label AS other, 1 - {_DOT} / ({_NQ} * {_NO}) AS distance {_PAIR}),
sm AS (SELECT i, label, other, avg(distance) AS m FROM dq GROUP BY 1, 2, 3), ab AS (SELECT i, label, max(CASE WHEN label = other THEN m END) AS a, min(CASE WHEN label <> other THEN m END) AS b FROM sm GROUP BY 1, 2)"""


@R.add("silhouette", sql("SELECT i, label, CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM ab", "silhouette", ctes=_SIL))
def silhouette(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    dist = similarity.query_distances(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding")
    return rounded(similarity.silhouettes(dist, e.select(F.col("vec_id").alias("i"), "label")))


_CON = """t AS (SELECT batch_id AS a, species AS b, CAST(count(*) AS DOUBLE) AS n FROM metadata WHERE batch_id IS NOT NULL AND species IS NOT NULL GROUP BY 1, 2),
ra AS (SELECT sum(s * (s - 1) / 2) AS c, sum(s * ln(s)) AS l FROM (SELECT sum(n) AS s FROM t GROUP BY a)), rb AS (SELECT sum(s * (s - 1) / 2) AS c, sum(s * ln(s)) AS l FROM (SELECT sum(n) AS s FROM t GROUP BY b)),
ce AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS c, sum(n * ln(n)) AS l FROM t)"""


@R.add(
    "concordance",
    sql(
        """SELECT (ce.c - ra.c * rb.c / (ce.n * (ce.n - 1) / 2)) / ((ra.c + rb.c) / 2 - ra.c * rb.c / (ce.n * (ce.n - 1) / 2)) AS ari,
2 * (ln(ce.n) + (ce.l - ra.l - rb.l) / ce.n) / ((ln(ce.n) - ra.l / ce.n) + (ln(ce.n) - rb.l / ce.n)) AS nmi, CAST(ce.n AS BIGINT) AS n FROM ce, ra, rb""", "ari", "nmi", ctes=_CON),
)
def concordance(spark, d):
    return rounded(similarity.concordance(_meta(spark, d).select("batch_id", "species"), "batch_id", "species"))


_WAS = """f AS (SELECT spectrum_no, mz, intensity FROM points WHERE spectrum_no = (SELECT min(spectrum_no) FROM points)),
ft AS (SELECT sum(intensity) AS t FROM f), pt AS (SELECT spectrum_no, sum(intensity) AS t FROM points GROUP BY 1),
ev AS (SELECT p.spectrum_no, p.mz, p.intensity / t AS w FROM points p JOIN pt USING (spectrum_no) UNION ALL SELECT pt.spectrum_no, f.mz, -f.intensity / ft.t FROM f, ft, pt),
g AS (SELECT spectrum_no, mz, sum(w) AS w FROM ev GROUP BY 1, 2),
cu AS (SELECT spectrum_no, mz, sum(w) OVER (PARTITION BY spectrum_no ORDER BY mz) AS c, lead(mz) OVER (PARTITION BY spectrum_no ORDER BY mz) AS nx FROM g)"""


def _first(spark, d):
    return peaks(spark, d).orderBy("spectrum_no").limit(1).collect()[0]


@R.add("wasserstein", sql("SELECT spectrum_no, sum(abs(c) * (nx - mz)) AS distance FROM cu WHERE nx IS NOT NULL OR c IS NULL GROUP BY 1", "distance", ctes=_WAS, digits=3))
def wasserstein(spark, d):
    import numpy as np

    f = _first(spark, d)
    return rounded(similarity.wasserstein_to(peaks(spark, d), np.asarray(f["mz"]), np.asarray(f["intensity"])), 3)


@R.add("dtw_distance")
def dtw_distance(spark, d):
    import numpy as np

    return rounded(similarity.dtw_to(peaks(spark, d), "mz", np.asarray(_first(spark, d)["mz"])))


def _grouped(method, **options):
    def run(spark, d):
        c = table(spark, d, "embeddings", "vec_id", "embedding").select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").alias("x"))
        # Refused before any pair is formed; the vectors of larger tables are clustered on posting lists.
        if c.limit(similarity.MOST_LOCAL + 1).count() > similarity.MOST_LOCAL:
            raise ValueError(f"more than {similarity.MOST_LOCAL} members")
        return similarity.clustered(similarity.query_distances(c, c, "id", "x"), method, **options)

    return run


R.add("hierarchical")(_grouped("hierarchical", clusters=3))
R.add("kmedoids")(_grouped("kmedoids", clusters=3))
R.add("hdbscan")(_grouped("hdbscan", min_samples=2, min_size=2))

# drift

_CUT = "cut AS (SELECT acquired_at AS c FROM (SELECT acquired_at, row_number() OVER (ORDER BY acquired_at) - 1 AS r, count(*) OVER () AS n FROM spectra) WHERE r = greatest(CAST(ceil(n * 0.2) AS BIGINT) - 1, 0))"
_WIN = _CUT + """, late AS (SELECT m.*, date_trunc('day', (SELECT min(acquired_at) FROM spectra, cut WHERE acquired_at > c)) AS o FROM matrix m, cut WHERE acquired_at > c),
win AS (SELECT *, CAST(o AS TIMESTAMP) + to_days(CAST(90 * floor(date_diff('second', CAST(o AS TIMESTAMP), date_trunc('second', acquired_at)) / (90 * 86400)) AS INTEGER)) AS window_start FROM late)"""


def _drift(spark, d, y=False):
    m = _labelled(spark, d, "acquired_at") if y else matrix(spark, d, "acquired_at")
    m = m.withColumnRenamed("acquired_at", "ts")
    cut = drift.baseline_end(spectra(spark, d), "acquired_at").first()["cut"]
    return m, cut


@R.add("drift_baseline", sql("SELECT c AS cut FROM cut", ctes=_CUT))
def drift_baseline(spark, d):
    return drift.baseline_end(spectra(spark, d), "acquired_at")


@R.add(
    "drift_reference",
    sql(
        """SELECT window_start, window_start + INTERVAL 90 DAY AS window_end, n_spectra, CASE WHEN sum(m * m) > 0 AND sum(r * r) > 0 THEN greatest(1 - sum(m * r) / sqrt(sum(m * m) * sum(r * r)), 0) ELSE 1 END AS distance_to_reference
FROM (SELECT window_start, n_spectra, bin_index, median(intensity) AS m FROM (SELECT window_start, spectrum_no, bin_index // 8 AS bin_index, sum(intensity) AS intensity FROM win GROUP BY 1, 2, 3) JOIN (SELECT window_start, count(DISTINCT spectrum_no) AS n_spectra FROM win GROUP BY 1 HAVING count(DISTINCT spectrum_no) >= 5) USING (window_start) GROUP BY 1, 2, 3)
JOIN (SELECT bin_index, median(intensity) AS r FROM (SELECT spectrum_no, bin_index // 8 AS bin_index, sum(intensity) AS intensity FROM matrix, cut WHERE acquired_at <= c GROUP BY 1, 2) GROUP BY 1) USING (bin_index) GROUP BY 1, 2, 3""",
        "distance_to_reference", ctes=_WIN,
    ),
)
def drift_reference(spark, d):
    m, cut = _drift(spark, d)
    # Medians of narrow bins are mostly zero: eight bins of 75 Da make one.
    m = m.groupBy("spectrum_no", "ts", F.floor(F.col("bin_index") / 8).cast("int").alias("bin_index")).agg(F.sum("intensity").alias("intensity"))
    return rounded(drift.reference_drift(m, cut, 90))


_BINS = [10, 40, 80, 120, 160]
_EFF = _WIN + """, wm AS (SELECT window_start, bin_index, count(*) FILTER (y = 1) AS n_r, count(*) FILTER (y = 0) AS n_s, avg(intensity) FILTER (y = 1) AS mr, avg(intensity) FILTER (y = 0) AS ms,
 var_samp(intensity) FILTER (y = 1) AS vr, var_samp(intensity) FILTER (y = 0) AS vs FROM win JOIN labels USING (spectrum_no) GROUP BY 1, 2 HAVING count(*) FILTER (y = 1) >= 5 AND count(*) FILTER (y = 0) >= 5),
we AS (SELECT *, CASE WHEN NOT ((n_r - 1) * vr + (n_s - 1) * vs) / (n_r + n_s - 2) > 0 THEN 0 ELSE (mr - ms) / sqrt(((n_r - 1) * vr + (n_s - 1) * vs) / (n_r + n_s - 2)) END AS effect_size FROM wm)"""


_LATE = _EFF.replace("FROM matrix m, cut WHERE acquired_at > c)", "FROM matrix m, cut WHERE acquired_at > c AND spectrum_no IN (SELECT spectrum_no FROM labels))").replace("(SELECT min(acquired_at) FROM spectra, cut WHERE acquired_at > c)", "(SELECT min(acquired_at) FROM spectra, cut WHERE acquired_at > c AND spectrum_no IN (SELECT spectrum_no FROM labels))")


@R.add("drift_effect_size", sql(f"SELECT window_start, bin_index, effect_size, n_r + n_s AS n_spectra FROM we WHERE bin_index IN ({', '.join(map(str, _BINS))})", "effect_size", ctes=_LATE))
def drift_effect_size(spark, d):
    m, cut = _drift(spark, d, True)
    return rounded(drift.window_effects(m, cut, _BINS, 90))


_TOP = list(range(0, 200, 10))


@R.add(
    "drift_peak_stability",
    sql(
        f"""SELECT window_start, count(*) FILTER (bin_index IN ({', '.join(map(str, _TOP))})) / (count(*) + {len(_TOP)} - count(*) FILTER (bin_index IN ({', '.join(map(str, _TOP))}))) AS stability_score, max(n_r + n_s) AS n_spectra
FROM (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY round(abs(effect_size), 9) DESC, bin_index) AS k FROM we) WHERE k <= 20 GROUP BY 1""",
        "stability_score", ctes=_LATE,
    ),
)
def drift_peak_stability(spark, d):
    m, cut = _drift(spark, d, True)
    return rounded(drift.peak_stability(m, _TOP, cut, 90))


@R.add("drift_tested_stability")
def drift_tested_stability(spark, d):
    m, cut = _drift(spark, d, True)
    return rounded(drift.tested_stability(m, cut, 90))


@R.add("drift_pca")
def drift_pca(spark, d):
    m, cut = _drift(spark, d)
    return rounded(drift.pca_drift(m, cut, 90), 4)


# all drugs through the whole analysis


def _per_drug(spark, d):
    """(drug, bin_index, fold_change, adjusted_p_value, ...) of every drug of the list, by rank-sum test and correction per drug."""
    drugs = [r[0] for r in table(spark, d, "drug_ref", "drug").where("drug is not null").orderBy("drug").collect()]
    r = records(spark, d).where(F.col("drug").isin(drugs)).select("id", "drug", susceptibility.mic_value(F.col("mic")).alias("v")).where("v is not null")
    m = spectra(spark, d).join(r, "id").select("drug", (F.col("v") > RESISTANT_ABOVE).cast("int").alias("y"), F.posexplode("x").alias("bin_index", "intensity"))
    return drugs, differential.analysis(m, by=["drug"])


@R.add("diff_by_drug")
def diff_by_drug(spark, d):
    return rounded(_per_drug(spark, d)[1])


@R.add("compare_all_drugs")
def compare_all_drugs(spark, d):
    """Bin x drug flags over the bins that are significant for any drug of the list."""
    drugs, results = _per_drug(spark, d)
    return differential.compared(results, drugs, fold=0.1, p=0.5)


@R.add("upset_all_drugs")
def upset_all_drugs(spark, d):
    drugs, results = _per_drug(spark, d)
    return differential.flag_sets(differential.compared(results, drugs, fold=0.1, p=0.5), drugs)


# plot data


@R.add(
    "plot_label_order",
    sql(
        """SELECT label, shown, row_number() OVER (ORDER BY g, number, label) AS place, n FROM (
SELECT label, CASE label WHEN 'S' THEN 'Susceptible' WHEN 'I' THEN 'Intermediate' WHEN 'R' THEN 'Resistant' ELSE label END AS shown, n,
 CASE WHEN label IN ('S', 'I', 'R') THEN 0 WHEN try_cast(label AS DOUBLE) IS NOT NULL THEN 1 WHEN label IS NOT NULL THEN 2 ELSE 3 END AS g,
 CASE label WHEN 'S' THEN 1 WHEN 'I' THEN 2 WHEN 'R' THEN 3 ELSE try_cast(label AS DOUBLE) END AS number
FROM (SELECT mic AS label, count(*) AS n FROM metadata WHERE mic IS NULL OR regexp_matches(mic, '^[0-9.]+$') GROUP BY 1))"""
    ),
)
def plot_label_order(spark, d):
    return plots.ordered_labels(_meta(spark, d).where(F.col("mic").isNull() | F.col("mic").rlike("^[0-9.]+$")), "mic")


_GEL = """mm AS (SELECT spectrum_no, y, avg(intensity) AS m FROM matrix JOIN labels USING (spectrum_no) GROUP BY 1, 2),
lanes AS (SELECT spectrum_no, y, row_number() OVER (PARTITION BY y ORDER BY round(m, 9) DESC, spectrum_no) AS place FROM mm),
cells AS (SELECT spectrum_no, 0 AS region, bin_index, ln(1 + intensity) AS shade FROM matrix WHERE 2000 + 75 * bin_index BETWEEN 3000 AND 4000
 UNION ALL SELECT spectrum_no, 1, bin_index, ln(1 + intensity) FROM matrix WHERE 2000 + 75 * bin_index BETWEEN 9000 AND 9500
 UNION ALL SELECT spectrum_no, 0, NULL, NULL FROM lanes)"""


@R.add("plot_pseudogel", sql("SELECT y, place, spectrum_no, CAST(region AS INTEGER) AS region, bin_index, shade FROM lanes JOIN cells USING (spectrum_no)", "shade", ctes=_GEL))
def plot_pseudogel(spark, d):
    m = matrix(spark, d).join(labels(spark, d).dropDuplicates(["spectrum_no"]), "spectrum_no")
    return rounded(plots.pseudogel(m, "y", [(3000.0, 4000.0), (9000.0, 9500.0)], START, WIDTH))


@R.add("plot_pca")
def plot_pca(spark, d):
    return rounded(plots.embedding(matrix(spark, d)), 4)


def _cohort(spark, d):
    """The embeddings as one cohort of spectra on one axis."""
    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.transform("embedding", lambda v, i: i.cast("double")).alias("mz"), F.col("embedding").alias("intensity"))


@R.add(
    "pairwise_cosine",
    "SELECT CAST(a.vec_id AS BIGINT) AS i, CAST(b.vec_id AS BIGINT) AS j, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id",
)
def pairwise_cosine(spark, d):
    return rounded(similarity.pairwise(_cohort(spark, d), "cosine", "vec_id"))


@R.add("heatmap_order")
def heatmap_order(spark, d):
    return similarity.leaf_order(similarity.pairwise(_cohort(spark, d), "cosine", "vec_id"))


@R.add("dendrogram")
def dendrogram(spark, d):
    return rounded(similarity.tree_of(similarity.pairwise(_cohort(spark, d), "cosine", "vec_id")))


@R.add("drift_monitor", R.sql["drift_reference"])
def drift_monitor(spark, d):
    """The reference drift of a fitted monitor on bins of 600 Da."""
    m = drift.timestamps(matrix(spark, d, "acquired_at"), "acquired_at")
    m = m.groupBy("spectrum_no", F.col("acquired_at").alias("ts"), F.floor(F.col("bin_index") / 8).cast("int").alias("bin_index")).agg(F.sum("intensity").alias("intensity"))
    return rounded(drift.Monitor(days=90).fit(m).reference(m))

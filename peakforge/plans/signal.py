"""Queries on single spectra: transforms, binning, quality, peaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakforge.functions.arrays import median, total
from peakforge.operators import alignment, binning, peaks, pipeline, plots, quality, raw_alignment, transforms
from peakforge.plans.registry import Registry
from peakforge.plans.views import START, WIDTH, matrix, points, rounded, spectra, sql
from peakforge.plans.views import peaks as peak_arrays

R = Registry()


def _long(df, name, *arrays):
    """One row per element of arrays that belong together."""
    z = F.posexplode(F.arrays_zip(*[F.col(a) for a in arrays]))
    return df.select(name, z.alias("pos", "z")).select(name, "pos", *[F.col(f"z.{a}").alias(a) for a in arrays])


@R.add("spectra_long", sql("SELECT * FROM points"))
def spectra_long(spark, d):
    return points(spark, d)


@R.add(
    "clip_sqrt_log",
    sql("SELECT spectrum_no, bin_index AS pos, greatest(intensity - 0.01, 0) AS clipped, sqrt(intensity) AS root, ln(1 + intensity) AS logged FROM matrix", "clipped", "root", "logged"),
)
def clip_sqrt_log(spark, d):
    s = spectra(spark, d).withColumn("low", F.transform("x", lambda v: v - 0.01))
    s = s.select("spectrum_no", transforms.clip_negatives(F.col("low")).alias("clipped"), transforms.sqrt(F.col("x")).alias("root"), transforms.log1p(F.col("x")).alias("logged"))
    return rounded(_long(s, "spectrum_no", "clipped", "root", "logged"))


@R.add("tic_normalize", sql("SELECT spectrum_no, pos, CASE WHEN t > 0 THEN intensity / t ELSE intensity END AS tic FROM (SELECT *, sum(intensity) OVER (PARTITION BY spectrum_no) AS t FROM points)", "tic"))
def tic_normalize(spark, d):
    return rounded(_long(peak_arrays(spark, d).select("spectrum_no", transforms.tic(F.col("intensity")).alias("tic")), "spectrum_no", "tic"))


@R.add("median_normalize", sql("SELECT spectrum_no, pos, CASE WHEN m > 0 THEN intensity / m ELSE intensity END AS scaled FROM (SELECT *, median(intensity) OVER (PARTITION BY spectrum_no) AS m FROM points)", "scaled"))
def median_normalize(spark, d):
    return rounded(_long(peak_arrays(spark, d).select("spectrum_no", transforms.median_normalised(F.col("intensity")).alias("scaled")), "spectrum_no", "scaled"))


_PQN = """tics AS (SELECT spectrum_no, bin_index, CASE WHEN t > 0 THEN intensity / t ELSE intensity END AS v FROM (SELECT *, sum(intensity) OVER (PARTITION BY spectrum_no) AS t FROM matrix)),
ref AS (SELECT bin_index, avg(v) AS r FROM tics GROUP BY bin_index),
quotients AS (SELECT spectrum_no, median(v / r) AS q FROM tics JOIN ref USING (bin_index) WHERE r > 0.0005 GROUP BY spectrum_no)"""


@R.add("pqn_normalize", sql("SELECT spectrum_no, bin_index AS pos, CASE WHEN q > 0 THEN v / q ELSE v END AS pqn FROM tics LEFT JOIN quotients USING (spectrum_no)", "pqn", ctes=_PQN))
def pqn_normalize(spark, d):
    s = spectra(spark, d).select("spectrum_no", transforms.tic(F.col("x")).alias("x"))
    means = s.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()
    ref = F.array(*[F.lit(float(r["m"]) if r["m"] > 0.0005 else 0.0) for r in means])
    return rounded(_long(s.select("spectrum_no", transforms.pqn(F.col("x"), ref).alias("pqn")), "spectrum_no", "pqn"))


@R.add("mz_trim", sql("SELECT spectrum_no, mz, intensity FROM points WHERE mz BETWEEN 4000 AND 10000"))
def mz_trim(spark, d):
    p = peak_arrays(spark, d).select("spectrum_no", F.explode(transforms.trim(F.arrays_zip("mz", "intensity"), 4000, 10000)).alias("p"))
    return p.select("spectrum_no", "p.mz", "p.intensity")


@R.add("mz_multi_trim", sql("SELECT spectrum_no, mz, intensity FROM points WHERE mz BETWEEN 2500 AND 3500 OR mz BETWEEN 7000 AND 8000"))
def mz_multi_trim(spark, d):
    p = peak_arrays(spark, d).select("spectrum_no", F.explode(transforms.trim_ranges(F.arrays_zip("mz", "intensity"), [(2500, 3500), (7000, 8000)])).alias("p"))
    return p.select("spectrum_no", "p.mz", "p.intensity")


_MA = """ SELECT a.spectrum_no, a.bin_index AS pos, (b.x[1 + CASE WHEN p0 < 0 THEN -p0 - 1 ELSE p0 END] + b.x[1 + CASE WHEN p1 < 0 THEN -p1 - 1 ELSE p1 END] + a.intensity
 + b.x[1 + CASE WHEN p3 > 239 THEN 479 - p3 ELSE p3 END] + b.x[1 + CASE WHEN p4 > 239 THEN 479 - p4 ELSE p4 END]) / 5 AS smooth
FROM (SELECT *, bin_index - 2 AS p0, bin_index - 1 AS p1, bin_index + 1 AS p3, bin_index + 2 AS p4 FROM matrix) a JOIN spectra b USING (spectrum_no)"""


@R.add("moving_average", sql(_MA, "smooth"))
def moving_average(spark, d):
    return rounded(_long(transforms.moving_average(spectra(spark, d).select("spectrum_no", F.col("x").alias("smooth")), "smooth", 5), "spectrum_no", "smooth"))


_W = "OVER (PARTITION BY spectrum_no ORDER BY bin_index ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)"


@R.add("tophat_baseline", sql(f"SELECT spectrum_no, bin_index AS pos, intensity - max(low) {_W} AS top FROM (SELECT *, min(intensity) {_W} AS low FROM matrix)", "top"))
def tophat_baseline(spark, d):
    return rounded(_long(transforms.top_hat(spectra(spark, d).select("spectrum_no", F.col("x").alias("top")), "top", 10), "spectrum_no", "top"))


def _steps(spark, d, *steps):
    s = spectra(spark, d).select("spectrum_no", F.transform("x", lambda v, i: START + WIDTH * i).alias("mz"), F.col("x").alias("intensity"))
    out = pipeline.Pipeline([(str(i), s_) for i, s_ in enumerate(steps)]).run(s)
    return rounded(_long(out, "spectrum_no", "mz", "intensity"))


@R.add("savgol")
def savgol(spark, d):
    return _steps(spark, d, pipeline.SavitzkyGolaySmooth(21, 2))


@R.add("snip")
def snip(spark, d):
    return _steps(spark, d, pipeline.SnipBaseline(40))


@R.add("convex_hull")
def convex_hull(spark, d):
    return _steps(spark, d, pipeline.ConvexHullBaseline())


@R.add("median_baseline")
def median_baseline(spark, d):
    return _steps(spark, d, pipeline.MedianBaseline(20))


@R.add("default_pipeline")
def default_pipeline(spark, d):
    s = spectra(spark, d).select("spectrum_no", F.transform("x", lambda v, i: START + WIDTH * i).alias("mz"), F.col("x").alias("intensity"))
    return rounded(_long(pipeline.Pipeline.default().run(s), "spectrum_no", "mz", "intensity"))


# binning

_BIN = "greatest(ceil((mz - 2000) / 300.0) - 1, 0)"


@R.add("bin_uniform", sql(f"SELECT spectrum_no, CAST({_BIN} AS INTEGER) AS bin_index, sum(intensity) AS intensity FROM points WHERE mz >= 2000 AND {_BIN} < 60 GROUP BY ALL", "intensity"))
def bin_uniform(spark, d):
    return rounded(binning.bin_points(points(spark, d), binning.uniform_bin(F.col("mz"), 2000.0, 300.0, 60), 60, fill=False))


_FILLED = f"""sums AS (SELECT spectrum_no, CAST({_BIN} AS INTEGER) AS bin_index, sum(intensity) AS s FROM points WHERE mz >= 2000 AND {_BIN} < 60 GROUP BY ALL),
grid AS (SELECT spectrum_no, CAST(unnest(range(60)) AS INTEGER) AS bin_index FROM peaks)"""


@R.add("bin_uniform_filled", sql("SELECT spectrum_no, bin_index, coalesce(s, 0) AS intensity FROM grid LEFT JOIN sums USING (spectrum_no, bin_index)", "intensity", ctes=_FILLED))
def bin_uniform_filled(spark, d):
    return rounded(binning.bin_points(points(spark, d), binning.uniform_bin(F.col("mz"), 2000.0, 300.0, 60), 60))


_CUSTOM = [2000.0, 3000.0, 4500.0, 6000.0, 9000.0, 14000.0, 20000.0]


def _edge_sql(edges):
    return " ".join(f"WHEN mz {'>=' if i == 0 else '>'} {a!r} AND mz <= {b!r} THEN {i}" for i, (a, b) in enumerate(zip(edges, edges[1:])))


@R.add("bin_custom", sql(f"SELECT spectrum_no, CAST(CASE {_edge_sql(_CUSTOM)} END AS INTEGER) AS bin_index, sum(intensity) AS intensity FROM points WHERE mz BETWEEN 2000 AND 20000 GROUP BY ALL", "intensity"))
def bin_custom(spark, d):
    e = binning.checked_edges(_CUSTOM)
    return rounded(binning.bin_points(points(spark, d), binning.edge_bin(F.col("mz"), e), len(e) - 1, fill=False))


_PROP = binning.proportional_edges(2000.0, 20000.0, 100.0)


@R.add("bin_proportional", sql(f"SELECT spectrum_no, CAST(CASE {_edge_sql(_PROP)} END AS INTEGER) AS bin_index, sum(intensity) AS intensity FROM points WHERE mz BETWEEN 2000 AND {_PROP[-1]!r} GROUP BY ALL", "intensity"))
def bin_proportional(spark, d):
    return rounded(binning.bin_points(points(spark, d), binning.edge_bin(F.col("mz"), _PROP), len(_PROP) - 1, fill=False))


@R.add("bin_metadata", "SELECT CAST(i AS INTEGER) AS bin_index, CAST(2000 + 300 * i AS DOUBLE) AS bin_start, CAST(2300 + 300 * i AS DOUBLE) AS bin_end, CAST(300 AS DOUBLE) AS bin_width FROM range(60) t(i)")
def bin_metadata(spark, d):
    return binning.bin_table(spark, binning.edges_of("uniform", 2000.0, 20000.0, 300.0))


@R.add("bin_adaptive")
def bin_adaptive(spark, d):
    s = spectra(spark, d).select("spectrum_no", F.transform("x", lambda v, i: START + WIDTH * i).alias("mz"), F.col("x").alias("intensity"))
    return rounded(binning.adaptive_bins(s, narrow=75.0, wide=600.0).where("intensity > 0"))


# quality

_REGION = "list_filter(list_zip(mz, intensity), lambda p: p[1] BETWEEN 12000 AND 20000)"
_QUALITY = """one AS (SELECT spectrum_no, intensity, mz BETWEEN 12000 AND 20000 AS far FROM points),
mid AS (SELECT spectrum_no, median(intensity) FILTER (far) AS m, quantile_cont(intensity, 0.1) AS q10, max(intensity) AS top, median(intensity) AS med_all FROM one GROUP BY 1),
dev AS (SELECT spectrum_no, median(abs(intensity - m)) FILTER (far) AS mad FROM one JOIN mid USING (spectrum_no) GROUP BY 1),
upper AS (SELECT spectrum_no, median(intensity) FILTER (intensity > q10) AS um FROM one JOIN mid USING (spectrum_no) GROUP BY 1),
base AS (SELECT spectrum_no, avg(CASE WHEN intensity < 2 * coalesce(mad / 0.6744897501960817, 0) THEN 1.0 ELSE 0.0 END) AS share FROM one JOIN dev USING (spectrum_no) GROUP BY 1)"""


@R.add(
    "quality_report",
    sql(
        """SELECT spectrum_no, coalesce(mad / 0.6744897501960817, 0) AS noise, CASE WHEN coalesce(mad, 0) = 0 THEN 0 ELSE share END AS baseline_fraction,
CASE WHEN um > 0 AND top > 0 THEN log10(top / um) ELSE 0 END AS dynamic_range, CASE WHEN coalesce(mad, 0) > 0 THEN least(top / (mad * 1.4826), 1e6) ELSE 1e6 END AS snr
FROM mid JOIN dev USING (spectrum_no) JOIN upper USING (spectrum_no) JOIN base USING (spectrum_no)""",
        "noise", "baseline_fraction", "dynamic_range", "snr", ctes=_QUALITY, digits=4,
    ),
)
def quality_report(spark, d):
    p = peak_arrays(spark, d).withColumn("far", quality.within(F.col("mz"), F.col("intensity"), 12000, 20000)).withColumn("noise", quality.noise_level(F.col("far")))
    out = p.select(
        "spectrum_no", "noise", quality.baseline_fraction(F.col("intensity"), F.col("noise")).alias("baseline_fraction"),
        quality.dynamic_range(F.col("intensity")).alias("dynamic_range"), quality.snr(F.col("intensity"), F.col("far")).alias("snr"),
    )
    return rounded(out, 4)


@R.add(
    "noise_mad",
    sql("SELECT spectrum_no, 1.4826 * median(abs(intensity - m)) AS noise FROM matrix JOIN (SELECT spectrum_no, median(intensity) AS m FROM matrix GROUP BY 1) USING (spectrum_no) GROUP BY 1", "noise"),
)
def noise_mad(spark, d):
    return rounded(spectra(spark, d).select("spectrum_no", quality.mad_noise(F.col("x")).alias("noise")))


@R.add(
    "snr_median_top",
    sql(
        """SELECT spectrum_no, CASE WHEN coalesce(mad, 0) > 0 THEN least(list_aggregate(list_sort(intensity, 'DESC')[1:10], 'median') / (mad * 1.4826), 1e6) ELSE 1e6 END AS snr
FROM peaks JOIN dev USING (spectrum_no)""",
        "snr", ctes=_QUALITY, digits=4,
    ),
)
def snr_median_top(spark, d):
    p = peak_arrays(spark, d).withColumn("far", quality.within(F.col("mz"), F.col("intensity"), 12000, 20000))
    return rounded(p.select("spectrum_no", quality.snr(F.col("intensity"), F.col("far"), 10).alias("snr")), 4)


@R.add("quality_full")
def quality_full(spark, d):
    s = spectra(spark, d).select("spectrum_no", F.transform("x", lambda v, i: START + WIDTH * i).alias("mz"), F.col("x").alias("intensity"))
    return rounded(quality.full_report(s), 4)


# peaks

_RUNS = """flat AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> intensity THEN 1 ELSE 0 END) OVER (PARTITION BY spectrum_no ORDER BY bin_index) AS run
 FROM (SELECT *, lag(intensity) OVER (PARTITION BY spectrum_no ORDER BY bin_index) AS prev FROM matrix)),
plateaus AS (SELECT spectrum_no, run, min(bin_index) AS a, max(bin_index) AS b, any_value(intensity) AS v FROM flat GROUP BY 1, 2),
tops AS (SELECT spectrum_no, CAST((a + b) // 2 AS INTEGER) AS pos, v AS intensity FROM
 (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r FROM plateaus WINDOW w AS (PARTITION BY spectrum_no ORDER BY run)) WHERE v > l AND v > r)"""


@R.add("local_peaks", sql("SELECT spectrum_no, pos, intensity FROM tops", "intensity", ctes=_RUNS))
def local_peaks(spark, d):
    return rounded(peaks.peak_rows(spectra(spark, d), "x"))


@R.add(
    "peak_statistics",
    sql("SELECT spectrum_no, CAST(count(intensity) AS INTEGER) AS n_peaks, coalesce(avg(intensity), 0) AS mean_intensity, coalesce(max(intensity), 0) AS max_intensity FROM spectra LEFT JOIN tops USING (spectrum_no) GROUP BY 1", "mean_intensity", "max_intensity", ctes=_RUNS),
)
def peak_statistics(spark, d):
    return rounded(peaks.peak_statistics(spectra(spark, d), "x"))


@R.add(
    "peakset_topk",
    sql("SELECT spectrum_no, CAST(2000 + 75 * pos AS DOUBLE) AS mz, intensity FROM (SELECT *, row_number() OVER (PARTITION BY spectrum_no ORDER BY intensity DESC, pos DESC) AS k FROM tops) WHERE k <= 12", "intensity", ctes=_RUNS),
)
def peakset_topk(spark, d):
    s = spectra(spark, d)
    sets = peaks.peak_set(s.withColumn("mz", F.transform("x", lambda v, i: START + WIDTH * i)), "mz", "x", 12)
    return rounded(sets.select("spectrum_no", F.explode(F.arrays_zip("mz", "intensity")).alias("p")).select("spectrum_no", "p.mz", "p.intensity"))


@R.add("peak_mask", sql("SELECT spectrum_no, bin_index AS pos, CASE WHEN t.pos IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS mask FROM matrix m LEFT JOIN tops t ON m.spectrum_no = t.spectrum_no AND m.bin_index = t.pos".replace("SELECT spectrum_no", "SELECT m.spectrum_no"), ctes=_RUNS))
def peak_mask(spark, d):
    return _long(peaks.peak_mask(spectra(spark, d).select("spectrum_no", "x"), "x"), "spectrum_no", "mask")


@R.add("peaks_prominence")
def peaks_prominence(spark, d):
    return rounded(peaks.detected(spectra(spark, d), "x", "local", prominence=0.005))


@R.add("peaks_persistence")
def peaks_persistence(spark, d):
    return rounded(peaks.detected(spectra(spark, d), "x", "ph", threshold=0.005))


# alignment

_REF = [2500.0, 4000.0, 5500.0, 7000.0, 8500.0, 10000.0, 12500.0, 15000.0, 17500.0]
_NEAR = f"near AS (SELECT p.spectrum_no, p.pos, p.mz, r AS ref, row_number() OVER (PARTITION BY p.spectrum_no, p.pos ORDER BY abs(r - p.mz), r DESC) AS k FROM points p JOIN (SELECT CAST(unnest({_REF!r}) AS DOUBLE) AS r) ON true)"


@R.add("nearest_reference", sql("SELECT spectrum_no, pos, ref FROM near WHERE k = 1", ctes=_NEAR))
def nearest_reference(spark, d):
    return points(spark, d).select("spectrum_no", "pos", alignment.nearest_reference(F.col("mz"), _REF).alias("ref"))


@R.add("align_shift", sql("SELECT spectrum_no, median(ref - mz) AS shift FROM near WHERE k = 1 GROUP BY 1", "shift", ctes=_NEAR))
def align_shift(spark, d):
    return rounded(peak_arrays(spark, d).select("spectrum_no", alignment.peak_shift(F.col("mz"), _REF).alias("shift")))


_LINE = _NEAR + """, pairs AS (SELECT spectrum_no, mz, ref FROM near WHERE k = 1),
fit AS (SELECT spectrum_no, regr_slope(ref, mz) AS s, regr_intercept(ref, mz) AS i FROM pairs GROUP BY 1),
res AS (SELECT spectrum_no, mz, ref, ref - s * mz - i AS r FROM pairs JOIN fit USING (spectrum_no)),
dev AS (SELECT spectrum_no, mz, ref, abs(r - m) AS dd FROM res JOIN (SELECT spectrum_no, median(r) AS m FROM res GROUP BY 1) USING (spectrum_no)),
kept AS (SELECT spectrum_no, mz, ref FROM dev JOIN (SELECT spectrum_no, 3 * 1.4826 * median(dd) AS lim FROM dev GROUP BY 1) USING (spectrum_no) WHERE round(dd, 9) <= round(lim, 9))"""


@R.add("align_linear", sql("SELECT spectrum_no, regr_slope(ref, mz) AS slope, regr_intercept(ref, mz) AS intercept, count(*) AS n_used FROM kept GROUP BY 1", "slope", "intercept", ctes=_LINE, digits=4))
def align_linear(spark, d):
    pairs = points(spark, d).select("spectrum_no", "mz", alignment.nearest_reference(F.col("mz"), _REF).alias("ref"))
    return rounded(alignment.line_fit(pairs, "spectrum_no", "mz", "ref"), 4)


_QUAL = """ref AS (SELECT bin_index, median(intensity) AS r FROM matrix GROUP BY 1),
moved AS (SELECT spectrum_no, bin_index, coalesce(lag(intensity) OVER (PARTITION BY spectrum_no ORDER BY bin_index), 0) AS intensity FROM matrix),
q AS (SELECT 'before' AS w, spectrum_no, corr(intensity, r) AS c, sqrt(avg((intensity - r) ** 2)) AS e FROM matrix JOIN ref USING (bin_index) GROUP BY 1, 2
 UNION ALL SELECT 'after', spectrum_no, corr(intensity, r), sqrt(avg((intensity - r) ** 2)) FROM moved JOIN ref USING (bin_index) GROUP BY 1, 2)"""


@R.add(
    "alignment_quality",
    sql(
        """SELECT a.spectrum_no, CASE WHEN isnan(coalesce(a.c, 0)) THEN 0 ELSE coalesce(a.c, 0) END AS corr_before, a.e AS rmse_before, CASE WHEN isnan(coalesce(b.c, 0)) THEN 0 ELSE coalesce(b.c, 0) END AS corr_after, b.e AS rmse_after
FROM q a JOIN q b ON a.spectrum_no = b.spectrum_no AND a.w = 'before' AND b.w = 'after'""",
        "corr_before", "rmse_before", "corr_after", "rmse_after", ctes=_QUAL, digits=4,
    ),
)
def alignment_quality(spark, d):
    before = matrix(spark, d)
    moved = spectra(spark, d).select("spectrum_no", F.posexplode(alignment.shift_binned(F.col("x"), F.lit(1.0), 5)).alias("bin_index", "intensity"))
    q = alignment.alignment_quality(before, moved, alignment.median_reference(before))
    return rounded(q, 4)


def _warp(method):
    def run(spark, d):
        s = spectra(spark, d)
        ref = [r["reference"] for r in alignment.median_reference(matrix(spark, d)).orderBy("bin_index").collect()]
        return rounded(_long(alignment.warped(s, "x", ref, method), "spectrum_no", "x"))

    return run


for _m in ("shift", "linear", "piecewise", "quadratic", "cubic", "lowess"):
    R.add(f"warp_{_m}")(_warp(_m))


@R.add("peaks_aligned")
def peaks_aligned(spark, d):
    out = alignment.aligned_peaks(peak_arrays(spark, d), _REF, "lowess")
    return rounded(_long(out, "spectrum_no", "mz", "intensity"))


# raw spectra, each on its own axis: here the bins' starts


def _axes(spark, d):
    return spectra(spark, d).select("spectrum_no", F.transform("x", lambda v, i: START + WIDTH * i).alias("mz"), F.col("x").alias("intensity"))


_GRID = """raw AS (SELECT spectrum_no, x, CAST(unnest(range(479)) AS INTEGER) AS pos FROM spectra),
held AS (SELECT spectrum_no, pos, (x[pos // 2 + 1] + x[(pos + 1) // 2 + 1]) / 2 AS v FROM raw),
refs AS (SELECT pos, median(v) AS reference FROM held GROUP BY 1)"""


@R.add("raw_reference", sql("SELECT pos, CAST(2000 + 37.5 * pos AS DOUBLE) AS mz, reference FROM refs", "reference", ctes=_GRID))
def raw_reference(spark, d):
    s = _axes(spark, d)
    return rounded(raw_alignment.reference_points(s, raw_alignment.common_axis(s, 37.5)))


@R.add("raw_moved")
def raw_moved(spark, d):
    s = _axes(spark, d)
    return rounded(_long(raw_alignment.moved(s, raw_alignment.fit(s, 37.5), most=150.0), "spectrum_no", "mz", "intensity"))


@R.add("raw_moved_binned")
def raw_moved_binned(spark, d):
    s = _axes(spark, d)
    out = raw_alignment.moved(s, raw_alignment.fit(s, 37.5), "lowess", most=150.0)
    return rounded(raw_alignment.binned(out, binning.uniform_edges(2000.0, 20000.0, 300.0)))


@R.add("raw_binned", sql("SELECT spectrum_no, CAST(greatest(ceil(75 * bin_index / 300.0) - 1, 0) AS INTEGER) AS bin_index, sum(intensity) AS intensity FROM matrix GROUP BY ALL", "intensity"))
def raw_binned(spark, d):
    return rounded(raw_alignment.binned(_axes(spark, d), binning.uniform_edges(2000.0, 20000.0, 300.0)))


_RAWQ = _GRID + """, late AS (SELECT spectrum_no, pos, CASE WHEN pos < 2 THEN 0 ELSE lag(v, 2) OVER (PARTITION BY spectrum_no ORDER BY pos) END AS v FROM held),
both_ AS (SELECT spectrum_no, (SELECT 1) AS one, corr(h.v, r.reference) AS b FROM held h JOIN refs r USING (pos) GROUP BY 1),
after_ AS (SELECT spectrum_no, corr(l.v, r.reference) AS a FROM late l JOIN refs r USING (pos) GROUP BY 1)"""


@R.add(
    "raw_quality",
    sql("SELECT spectrum_no, c AS corr_before, e AS corr_after, e - c AS improvement FROM (SELECT spectrum_no, CASE WHEN isnan(coalesce(b, 0)) THEN 0 ELSE coalesce(b, 0) END AS c, CASE WHEN isnan(coalesce(a, 0)) THEN 0 ELSE coalesce(a, 0) END AS e FROM both_ JOIN after_ USING (spectrum_no))", "corr_before", "corr_after", "improvement", ctes=_RAWQ, digits=4),
)
def raw_quality(spark, d):
    """The spectra against the same ones moved by one bin."""
    s = _axes(spark, d)
    ref = raw_alignment.fit(s, 37.5)
    late = s.withColumn("mz", F.transform("mz", lambda v: v + WIDTH))
    return rounded(raw_alignment.quality(s, late, ref), 4)


@R.add("peaks_by_prominence")
def peaks_by_prominence(spark, d):
    return rounded(_long(peaks.peak_set(_axes(spark, d), "mz", "intensity", 12, rank_by="prominence"), "spectrum_no", "mz", "intensity", "score"))


@R.add("peaks_by_persistence")
def peaks_by_persistence(spark, d):
    return rounded(_long(peaks.peak_set(_axes(spark, d), "mz", "intensity", 12, rank_by="persistence", method="ph", threshold=0.005), "spectrum_no", "mz", "intensity", "score"))


@R.add("peaks_aligned_piecewise")
def peaks_aligned_piecewise(spark, d):
    return rounded(_long(alignment.aligned_peaks(peak_arrays(spark, d), _REF, "piecewise"), "spectrum_no", "mz", "intensity"))


R.add("warp_dtw")(_warp("dtw"))


@R.add("warp_to_row")
def warp_to_row(spark, d):
    s = spectra(spark, d)
    return rounded(_long(alignment.warped(s, "x", alignment.reference_row(s, "x", 0), "shift"), "spectrum_no", "x"))


# plot data


@R.add("plot_spectrum", sql("SELECT spectrum_no, pos, mz, intensity, CASE WHEN top > 0 THEN intensity / top ELSE 0 END AS share FROM (SELECT *, max(intensity) OVER (PARTITION BY spectrum_no) AS top FROM points)", "intensity", "share"))
def plot_spectrum(spark, d):
    return rounded(plots.spectrum_lines(peak_arrays(spark, d)))


@R.add("plot_peaks", sql("SELECT m.spectrum_no, m.bin_index AS pos, m.intensity, t.pos IS NOT NULL AS is_peak FROM matrix m LEFT JOIN tops t ON m.spectrum_no = t.spectrum_no AND m.bin_index = t.pos", "intensity", ctes=_RUNS))
def plot_peaks(spark, d):
    lines = matrix(spark, d).withColumnRenamed("bin_index", "pos")
    return rounded(plots.peak_overlay(lines, peaks.peak_rows(spectra(spark, d), "x")))


@R.add(
    "plot_before_after",
    sql("SELECT spectrum_no, bin_index, 'before' AS stage, intensity FROM matrix UNION ALL SELECT spectrum_no, bin_index, 'after', coalesce(lag(intensity) OVER (PARTITION BY spectrum_no ORDER BY bin_index), 0) FROM matrix", "intensity"),
)
def plot_before_after(spark, d):
    moved = spectra(spark, d).select("spectrum_no", F.posexplode(alignment.shift_binned(F.col("x"), F.lit(1.0), 5)).alias("bin_index", "intensity"))
    return rounded(plots.before_after(matrix(spark, d), moved))

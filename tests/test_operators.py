"""Operators without SQL twins against brute force and known values."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakforge.functions import kernels as K
from peakforge.functions import stats
from peakforge.functions.numbers import with_ranges
from peakforge.operators import alignment, differential, drift, evaluation, peaks, plots, quality, raw_alignment, replicates, scoring, similarity, transforms
from peakforge.session import fitting, shared_dir, write_shared


def axis_frame(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in m] if m is not None else None, [float(v) for v in x] if x is not None else None, "clash") for i, m, x in rows], "spectrum_no bigint, mz array<double>, intensity array<double>, pos string")


def bumps(mz, centres, width=6.0):
    return sum(np.exp(-0.5 * ((mz - c) / width) ** 2) * (1 + i % 3) for i, c in enumerate(centres))


CENTRES = [2100.0, 2350.0, 2600.0, 2850.0, 3100.0, 3350.0, 3600.0, 3850.0]


def shifted(spark, shifts):
    rows = []
    for i, s in enumerate(shifts):
        mz = np.arange(2000 + i % 2, 4000, 1.5 + 0.1 * (i % 3))
        rows.append((i, mz, bumps(mz, [c + s for c in CENTRES])))
    return axis_frame(spark, rows + [(90, None, None), (91, [], []), (92, [2000.0], None)])


@pytest.mark.parametrize("half", [1, 3, 10])
def test_rolling_and_top_hat_equal_their_definition(half):
    rng = np.random.default_rng(half)
    for n in (2 * half + 1, 40, 41, 97):
        x = rng.integers(0, 9, n).astype(float)
        low = np.array([x[max(0, i - half) : i + half + 1].min() for i in range(n)])
        high = np.array([low[max(0, i - half) : i + half + 1].max() for i in range(n)])
        assert (K.rolling(x, half, True) == low).all() and (K.top_hat(x, half) == x - high).all()
    with pytest.raises(ValueError):
        K.top_hat(np.zeros(2 * half), half)


def test_kernel_columns_keep_nulls_and_other_columns(spark):
    df = axis_frame(spark, [(1, [], []), (2, None, None), (3, [1, 2, 3], [1, 5, 1])])
    got = {r["spectrum_no"]: (r["intensity"], r["pos"]) for r in transforms.by_kernel(df, "intensity", lambda v: v * 2).collect()}
    assert got == {1: ([], "clash"), 2: (None, "clash"), 3: ([2.0, 10.0, 2.0], "clash")}
    assert transforms.moving_average(df.limit(0), "intensity", 3).count() == 0
    p = {r["spectrum_no"]: r["peaks"] for r in peaks.with_maxima(df, "intensity").collect()}
    assert p == {1: [], 2: None, 3: [1]}


def test_widths_of_a_triangle():
    x = np.concatenate([[0], np.arange(0, 11), np.arange(9, -1, -1), [0]]).astype(float)
    p = K.local_peaks(x)
    assert K.widths(x, p, K.prominences(x, p)).tolist() == [10.0]
    assert len(K.local_peaks(x, width=10)) == 1 and len(K.local_peaks(x, width=10.5)) == 0


def test_peak_sets_by_rank(spark):
    mz = np.arange(10.0)
    x = [0, 5, 4, 6, 0, 3, 0, 3, 0, 0]
    df = axis_frame(spark, [(1, mz, x), (2, mz, [0] * 10), (3, None, None)])
    one = {r["spectrum_no"]: (r["mz"], r["score"]) for r in peaks.peak_set(df, "mz", "intensity", 2).collect()}
    assert one == {1: ([1.0, 3.0], [5.0, 6.0]), 2: ([], [])}
    assert peaks.peak_set(df, "mz", "intensity", 3).where("spectrum_no = 1").first()["mz"] == [1.0, 3.0, 7.0]  # of equal heights the later
    r = peaks.peak_set(df, "mz", "intensity", 2, rank_by="prominence").where("spectrum_no = 1").first()
    assert (r["mz"], r["score"]) == ([3.0, 7.0], [6.0, 3.0])
    r = peaks.peak_set(df, "mz", "intensity", 2, rank_by="persistence", method="ph").where("spectrum_no = 1").first()
    assert r["mz"][0] == 3.0 and r["score"][0] == 6.0
    for bad in ({"rank_by": "persistence"}, {"rank_by": "prominence", "method": "ph"}, {"rank_by": "size"}, {"k": 0}):
        with pytest.raises(ValueError):
            peaks.peak_set(df, "mz", "intensity", **bad)


def test_raw_alignment_brings_peaks_together(spark):
    df = shifted(spark, [0, 0, 0, 3, -3, 2, -2])
    ref = raw_alignment.fit(df, 0.5, prominence=0.2)
    assert len(ref.peaks) == len(CENTRES) and np.abs(ref.peaks - CENTRES).max() <= 1
    for method in ("shift", "linear", "piecewise", "quadratic", "cubic", "lowess"):
        out = raw_alignment.moved(df, ref, method, prominence=0.2)
        assert out.count() == 7
        for r in out.collect():
            mz, x = np.array(r["mz"]), np.array(r["intensity"])
            top = mz[K.local_peaks(x, prominence=0.1)]
            assert np.abs(top - CENTRES).max() < 2.3, method  # steps are up to 1.7 wide, the reference is off by up to 1
        q = raw_alignment.quality(df, out, ref).collect()
        assert len(q) == 7 and all(r["improvement"] > -0.02 for r in q) and max(r["improvement"] for r in q) > 0.03
    bins = raw_alignment.binned(df, [2000.0, 3000.0, 4000.0])
    got = {(r["spectrum_no"], r["bin_index"]): r["intensity"] for r in bins.collect()}
    r = df.where("spectrum_no = 4").first()
    mz, x = np.array(r["mz"]), np.array(r["intensity"])
    assert got[4, 0] == pytest.approx(x[(mz >= 2000) & (mz <= 3000)].sum()) and got[4, 1] == pytest.approx(x[(mz > 3000) & (mz <= 4000)].sum())
    first = raw_alignment.fit(df, 0.5, prominence=0.2, reference=3)
    assert np.abs(first.peaks - np.array(CENTRES) - 3).max() <= 1
    with pytest.raises(ValueError):
        raw_alignment.fit(df, 0.5, reference=99)
    with pytest.raises(ValueError):
        raw_alignment.common_axis(axis_frame(spark, [(1, [1, 2], [0, 0]), (2, [3, 4], [0, 0])]))
    with pytest.raises(ValueError):
        raw_alignment.common_axis(df.limit(0))
    with pytest.raises(ValueError):
        raw_alignment.moved(df, ref, "guess")


def test_dtw_of_raw_spectra(spark):
    mz = np.arange(0.0, 40.0)
    df = axis_frame(spark, [(1, mz, bumps(mz, [10, 30], 2)), (2, mz, bumps(mz, [12, 30], 2))])
    ref = raw_alignment.Reference(mz, bumps(mz, [10, 30], 2), np.array([10.0, 30.0]))
    for r in raw_alignment.moved(df, ref, "dtw").collect():
        assert K.local_peaks(np.array(r["intensity"]), prominence=0.2)[0] == 10


def test_warping_rejects_other_lengths_and_warns(spark):
    df = axis_frame(spark, [(1, range(20), [0.0] * 20), (2, range(19), [0.0] * 19)])
    with pytest.warns(UserWarning, match="only 0 peaks"):
        bad = alignment.warped(df, "intensity", np.zeros(20), "shift")
    with pytest.raises(Exception, match="19 points"):
        bad.collect()
    with pytest.raises(ValueError):
        alignment.warped(df, "intensity", np.zeros(20), "guess")
    assert alignment.reference_row(df, "intensity", 1).shape == (19,)
    with pytest.raises(ValueError):
        alignment.reference_row(df, "intensity", 2)


def test_piecewise_peaks(spark):
    ref = [10.0, 20.0, 30.0, 40.0, 50.0, 60.0]
    df = axis_frame(spark, [(1, [11, 21, 31, 41, 51, 61], [1] * 6), (2, [], []), (3, [12], [1])])
    got = {r["spectrum_no"]: r["mz"] for r in alignment.aligned_peaks(df, ref, "piecewise", segments=2).collect()}
    assert np.allclose(got[1], ref) and got[2] == [] and got[3] == [10.0]
    with pytest.raises(ValueError):
        alignment.aligned_peaks(df, ref, "guess")


def test_pairwise_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, np.arange(12), np.abs(rng.normal(size=12))) for i in range(25)] + [(70, np.arange(12), np.zeros(12))]
    df = axis_frame(spark, rows + [(80, None, None)])
    for metric in ("cosine", "angle", "pearson", "wasserstein", "dtw"):
        got = {(r["i"], r["j"]): r["distance"] for r in similarity.pairwise(df, metric, block=7).collect()}
        want = {(a, b): similarity.distance_of(metric, ma.astype(float), xa, mb.astype(float), xb) for a, ma, xa in rows for b, mb, xb in rows if a < b}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, nan_ok=True) for k, v in want.items()), metric
    order = similarity.leaf_order(similarity.pairwise(df, "cosine", block=7)).collect()
    assert sorted(r["i"] for r in order) == sorted(r[0] for r in rows) and sorted(r["place"] for r in order) == list(range(1, 27))
    assert similarity.tree_of(similarity.pairwise(df, "cosine", block=7)).count() == 25
    with pytest.raises(ValueError):
        similarity.pairwise(df, "guess")
    assert similarity.pairwise(df.limit(0), "cosine").count() == 0


def test_value_ranges_rise_and_are_even(spark):
    df = spark.range(6400).select((F.col("id") % 2).alias("g"), (F.col("id") / 6400).alias("v"))
    r = with_ranges(df, "v", ["g"]).groupBy("g", "_r").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("g", "_r").collect()
    assert max(x["n"] for x in r) <= 100 and all(a["hi"] < b["lo"] for a, b in zip(r, r[1:]) if a["g"] == b["g"])
    curve = evaluation.error_curve(df.withColumn("y_true", (F.col("v") > 0.5).cast("int")).withColumn("score", F.col("v")))
    best = curve.where("threshold >= 0.5002").orderBy("threshold").first()
    assert best["vme"] < 0.001 and best["me"] == 0


def test_analysis_by_drug_equals_each_alone(spark):
    rng = np.random.default_rng(1)
    rows = [(d, i, b, float(rng.normal() + (y if b == 2 else 0)), y) for d in ("a", "b") for i, y in enumerate([0, 1] * 8) for b in range(4)] + [("only", i, 0, 1.0, 1) for i in range(4)]
    df = spark.createDataFrame(rows, "drug string, spectrum_no int, bin_index int, intensity double, y int")
    got = {(r["drug"], r["bin_index"]): r for r in differential.analysis(df, by=["drug"]).collect()}
    assert {d for d, _ in got} == {"a", "b"}
    for d in ("a", "b"):
        for r in differential.analysis(df.where(F.col("drug") == d)).collect():
            assert got[d, r["bin_index"]]["adjusted_p_value"] == pytest.approx(r["adjusted_p_value"]) and got[d, r["bin_index"]]["fold_change"] == pytest.approx(r["fold_change"], nan_ok=True)
    with pytest.raises(ValueError, match="both classes"):
        differential.analysis(df.where("y = 1"))


def test_rank_sum_p_is_exact_for_any_size():
    u, n = 1200.0, 300
    ways = stats.rank_sum_ways(5, n)
    assert stats.mann_whitney_p(u, 5, n, 0) == pytest.approx(2 * sum(ways[int(u):]) / sum(ways)) == stats.mann_whitney_p(u, n, 5, 0)


def test_quality_counts_peaks_above_the_noise(spark):
    mz = np.linspace(2000, 20000, 400)
    x = 0.001 * (1 + np.sin(np.arange(400) * 2.1)) / 2
    x[[50, 120, 200]] += 1
    df = axis_frame(spark, [(1, mz, x), (2, mz, np.zeros(400))])
    got = {r["spectrum_no"]: r for r in quality.full_report(df).collect()}
    assert got[1]["peak_count"] == 3 and got[2]["peak_count"] == 0 and got[1]["total_ion_count"] == pytest.approx(x.sum())


def test_overlap_of_replicates(spark):
    df = spark.createDataFrame([("a", [0.0, 1.0, 2.0, 3.0], [0.0, 1.0, 2.0, 3.0]), ("a", [1.0, 1.5, 2.0, 2.5], [3.0, 3.5, 4.0, 4.5]), ("b", [5.0, 6.0], [1.0, 2.0]), ("b", None, None)], "g string, mz array<double>, intensity array<double>")
    got = {r["g"]: (r["mz"], r["intensity"]) for r in replicates.merge_overlap(df, "g").collect()}
    assert got["a"] == ([1.0, 1.5, 2.0, 2.5], [2.0, 2.5, 3.0, 3.5]) and got["b"] == ([5.0, 6.0], [1.0, 2.0])


def test_evaluators(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)], "label double, prediction double")
    assert scoring.very_major().evaluate(df) == 0.5 and scoring.major().evaluate(df) == 0.25
    assert not scoring.very_major().isLargerBetter() and scoring.RateEvaluator("sensitivity").isLargerBetter()
    with pytest.raises(ValueError):
        scoring.RateEvaluator("guess")


def test_monitor(spark):
    rows = [(i, f"2024-0{1 + i // 10}-{10 + i % 10} 00:00:00", b, float(b + i % 3)) for i in range(40) for b in range(3)]
    m = spark.createDataFrame(rows, "spectrum_no int, ts string, bin_index int, intensity double")
    t = drift.timestamps(m, "ts")
    assert drift.Monitor().fit(t).reference(t).count() >= 1
    with pytest.raises(ValueError, match="two spectra"):
        drift.Monitor(share=0.2).fit(t.where("spectrum_no < 3"))
    with pytest.raises(ValueError, match="fit"):
        drift.Monitor().reference(t)
    with pytest.raises(Exception, match="holds no time"):
        drift.timestamps(spark.createDataFrame([("soon",)], "ts string"), "ts").collect()


def test_plot_frames(spark):
    df = spark.createDataFrame([("R",), ("S",), ("I",), ("10",), ("9.5",), ("x",), (None,), ("S",)], "label string")
    got = [(r["label"], r["shown"], r["n"]) for r in plots.ordered_labels(df, "label").orderBy("place").collect()]
    assert [g[0] for g in got] == ["S", "I", "R", "9.5", "10", "x", None] and got[0] == ("S", "Susceptible", 2)
    lines = plots.spectrum_lines(axis_frame(spark, [(1, [1, 2], [2, 4]), (2, [1], [0]), (3, None, None)]))
    assert {(r["spectrum_no"], r["pos"]): r["share"] for r in lines.collect()} == {(1, 0): 0.5, (1, 1): 1.0, (2, 0): 0.0}


def test_shared_folder_is_needed(spark, monkeypatch):
    assert shared_dir(spark)
    held = spark.sparkContext.getConf

    class Bare:
        def get(self, *_):
            return None

    monkeypatch.setattr(spark.sparkContext, "getConf", lambda: Bare())
    monkeypatch.setattr(type(spark.conf), "get", lambda *_: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        write_shared(spark.range(3), "t")
    assert held


def test_broadcast_only_behind_a_size(spark):
    t = write_shared(spark.range(1000), "t")
    assert "ResolvedHint (strategy=broadcast)" in fitting(t)._jdf.queryExecution().toString() or "broadcast" in fitting(t)._jdf.queryExecution().toString()
    assert "broadcast" not in fitting(t, 10)._jdf.queryExecution().toString()


warnings.filterwarnings("ignore", message="the reference has only")

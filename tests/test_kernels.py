import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peakforge.functions import kernels as K
from peakforge.functions import stats
from peakforge.functions.arrays import quantile
from peakforge.operators import alignment, binning, differential, evaluation, filters, peaks, pipeline, replicates, similarity, susceptibility, transforms

spectra_st = st.lists(st.floats(0, 1e4, allow_nan=False), min_size=25, max_size=80)


@settings(max_examples=40, deadline=None)
@given(spectra_st)
def test_baselines_never_exceed_the_signal(x):
    x = np.array(x)
    assert (K.snip_baseline(x, 10) <= x + 1e-6).all()
    assert (K.hull_baseline(np.arange(len(x), dtype=float), x) <= x + 1e-6 * max(1, x.max())).all()


def test_savitzky_golay_reproduces_polynomials():
    t = np.arange(60.0)
    y = 3 - 2 * t + 0.5 * t**2
    assert np.allclose(K.savitzky_golay(y, 21, 2), y)
    with pytest.raises(ValueError):
        K.savitzky_golay(y, 20, 2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=0, max_size=40))
def test_local_peaks_by_definition(x):
    x = np.array(x, float)
    want = []
    i = 1
    while i < len(x) - 1:
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            want.append((i + j) // 2)
        i = j + 1
    assert K.local_peaks(x).tolist() == want


def test_persistence_known_answers():
    x = np.zeros(200)
    x[[40, 90, 160]] = [0.6, 1.0, 0.8]
    assert K.persistence_peaks(x, 0.5)[0].tolist() == [40, 90, 160]
    y = np.zeros(100)
    y[30:35], y[70] = 0.9, 1.0
    p = K.persistence_peaks(y, 0.5)[0]
    assert len(p) == 2 and 30 <= p[0] <= 34 and p[1] == 70
    assert len(K.persistence_peaks(np.ones(9), 0)[0]) == 0


def test_nearest_goes_to_the_right_on_ties():
    assert K.nearest(np.array([1.5, 0.0, 9.0]), np.array([1.0, 2.0])).tolist() == [1, 0, 1]


@pytest.mark.parametrize("method", ["shift", "linear", "piecewise", "quadratic", "lowess"])
def test_alignment_recovers_a_shift(method):
    axis = np.arange(300.0)
    bump = lambda at: sum(np.exp(-0.5 * ((axis - c) / 2) ** 2) for c in at)
    centres = np.array([40.0, 90.0, 140.0, 200.0, 260.0])
    ref, moved = bump(centres), bump(centres + 4)
    out = K.align(method, axis, moved, K.local_peaks(moved, prominence=0.1).astype(float), centres)
    assert np.corrcoef(out, ref)[0, 1] > 0.97 > np.corrcoef(moved, ref)[0, 1]


def test_warp_path_and_wasserstein():
    a = np.array([0, 1, 2, 1, 0.0])
    assert K.warp_path(a, a)[1] == 0
    assert K.warp_path(a, np.array([0, 0, 1, 2, 1, 0.0]))[1] == 0
    assert K.wasserstein(np.array([1.0, 2.0]), np.array([1.0, 1.0]), np.array([3.0, 4.0]), np.array([5.0, 5.0])) == pytest.approx(2)
    assert math.isnan(K.wasserstein(np.array([1.0]), np.array([0.0]), np.array([1.0]), np.array([1.0])))


def test_clustering_finds_planted_groups():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.5, (8, 4)) for c in (0, 10, 20)])
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    truth = np.repeat([0, 1, 2], 8)
    for labels in (K.cut_tree(K.linkage(d), 24, clusters=3), K.cut_tree(K.linkage(d, "ward"), 24, clusters=3), K.medoids(d, 3)[1], K.density_clusters(d, 3, 4)):
        assert len(set(labels)) == 3 and all(len(set(labels[truth == k])) == 1 for k in range(3))
    with pytest.raises(ValueError):
        K.cut_tree(K.linkage(d), 24)


def test_tof_calibration():
    assert K.tof_to_mz(np.array([100.0]), 1e12, 400.0, 0.0)[0] == pytest.approx(300.0**2)
    with pytest.raises(ValueError):
        K.tof_to_mz(np.array([1.0]), 0, 1, 1)


def test_p_values():
    assert stats.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert stats.student_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert stats.student_two_sided(12.706204736432095, 1) == pytest.approx(0.05)
    assert sum(stats.rank_sum_ways(3, 4)) == math.comb(7, 3) and stats.rank_sum_ways(2, 2) == [1, 1, 2, 1, 1]
    assert stats.mann_whitney_p(0, 3, 3, 0) == pytest.approx(0.1)


def _array(spark, x):
    return spark.createDataFrame([(1, x)], "spectrum_no bigint, x array<double>")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=0, max_size=20))
def test_maxima_in_sql_equal_the_kernel(spark, x):
    got = peaks.with_maxima(_array(spark, [float(v) for v in x]), "x", "p").first()["p"]
    assert got == K.local_peaks(np.array(x, float)).tolist()


def test_arrays_and_transforms_edge_cases(spark):
    df = spark.createDataFrame([(1, []), (2, None), (3, [0.0, 0.0]), (4, [1.0, 3.0])], "spectrum_no bigint, x array<double>")
    got = {r["spectrum_no"]: r["t"] for r in df.select("spectrum_no", transforms.tic(F.col("x")).alias("t")).collect()}
    assert got == {1: [], 2: None, 3: [0.0, 0.0], 4: [0.25, 0.75]}
    assert df.select(quantile(F.col("x"), 0.25).alias("q")).collect()[3]["q"] == 1.5
    with pytest.raises(ValueError):
        transforms.moving_average(None, "x", 4)


def test_edges_cover_and_rise():
    for e in (binning.uniform_edges(2000, 20000, 7), binning.proportional_edges(2000, 20000, 5)):
        assert e[0] == 2000 and e[-1] >= 20000 and all(b > a for a, b in zip(e, e[1:]))
    assert len(binning.uniform_edges()) == 6001
    with pytest.raises(ValueError):
        binning.checked_edges([2000, 2000.5, 20000])
    binning.register_binning("mine", lambda lo, hi, w: [lo, hi])
    assert binning.edges_of("mine", 1, 5) == [1, 5]
    binning.unregister_binning("mine")
    with pytest.raises(ValueError):
        binning.unregister_binning("uniform")


def test_bins_are_closed_on_the_right(spark):
    e = [2000.0, 2003.0, 2006.0, 2010.0]
    df = spark.createDataFrame([(v,) for v in (1999.9, 2000.0, 2003.0, 2003.1, 2006.0, 2010.0, 2010.1)], "mz double")
    assert [r[0] for r in df.select(binning.edge_bin(F.col("mz"), e)).collect()] == [None, 0, 0, 1, 1, 2, None]
    assert [r[0] for r in df.select(binning.uniform_bin(F.col("mz"), 2000.0, 3.0, 3)).collect()] == [None, 0, 0, 1, 1, None, None]


def test_pipeline_round_trip(spark, tmp_path):
    p = pipeline.Pipeline.default()
    for name in ("p.json", "p.yaml"):
        p.save(str(tmp_path / name))
        assert pipeline.Pipeline.load(str(tmp_path / name)).to_dict() == p.to_dict()
    assert json.loads((tmp_path / "p.json").read_text())["steps"][0]["step"] == "ClipNegatives"
    assert p.mz_range == (2000.0, 20000.0) and p.get_step("smooth").window == 21
    with pytest.raises(KeyError):
        p.get_step("none")
    x = np.abs(np.sin(np.arange(100))) * 10
    df = spark.createDataFrame([(1, [2000.0 + 10 * k for k in range(100)], [float(v) for v in x]), (2, [], []), (3, None, None)], "spectrum_no bigint, mz array<double>, intensity array<double>")
    out = {r["spectrum_no"]: r["intensity"] for r in p.run(df).collect()}
    assert sum(out[1]) == pytest.approx(1) and out[2] == [] and out[3] is None


def test_shift_rounds_half_to_even(spark):
    df = _array(spark, [1.0, 2.0, 3.0, 4.0])
    for s, want in ((2.5, [0, 0, 1, 2]), (-1.5, [3, 4, 0, 0]), (0.5, [1, 2, 3, 4]), (9.0, [0, 0, 0, 1])):
        assert df.select(alignment.shift_binned(F.col("x"), F.lit(s), 3).alias("y")).first()["y"] == want


def test_filters_are_two_valued(spark):
    df = spark.createDataFrame([("a", 1.0), (None, float("nan")), ("b", None)], "species string, snr double")
    rule = filters.species("a")
    assert filters.apply(df, rule).count() + filters.apply(df, ~rule).count() == 3
    assert filters.apply(df, filters.quality(min_snr=0.5)).count() == 2
    assert filters.apply(df, filters.quality(min_peaks=1)).count() == 0


def test_duplicates_known_answers(spark):
    df = spark.createDataFrame([("A", 1, "p1"), ("A", 2, "p2"), ("B", 3, "p1"), ("C", 4, "p1"), ("C", 5, "p2")], "ID string, value int, pos string")
    ids = lambda s, **k: sorted(r["ID"] for r in replicates.resolve_duplicates(df, "ID", ["value"], s, **k).collect())
    assert ids("keep_all") == ["A_rep1", "A_rep2", "B_rep1", "C_rep1", "C_rep2"] and ids("keep_all", suffix="pos")[0] == "A_p1"
    assert ids("drop") == ["B"] and ids("first") == ["A", "B", "C"]


def test_breakpoints_known_answers(spark):
    t = spark.createDataFrame([(1, "E", "D", 9.0, 9.0, None, None, "old"), (2, "e ", "d", 1.0, 2.0, 4.0, 8.0, "new"), (3, "E", "X", 8.0, 8.0, 16.0, None, "s")], "row_no bigint, species string, drug string, s_le double, r_gt double, atu_low double, atu_high double, source string")
    rows = spark.createDataFrame([(1, "E", "D", "1"), (2, "E", "D", "2"), (3, "E", "D", "2,001"), (4, "E", "D", "4"), (5, "E", "X", ">16"), (6, "E", "Q", "1"), (7, "E", "D", "S"), (8, "E", "X", "8"), (9, None, None, None)], "k int, species string, drug string, mic string")
    got = {r["k"]: (r["category"], r["atu"], r["source"], r["censored"]) for r in susceptibility.encoded(rows, t).collect()}
    assert got[1] == ("S", False, "new", False) and got[2][0] == "I" and got[3][0] == "R" and got[4][:2] == ("R", True)
    assert got[5] == ("R", True, "s", True) and got[6] == (None, None, None, False) and got[7][:3] == (None, False, "new") and got[8][0] == "S" and got[9][0] is None


def test_evaluation_known_answers(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (0.0, 2.0), (None, 1.0)], "log2_true double, log2_pred double")
    r = evaluation.mic_report(df).first()
    assert (r["n"], r["essential_agreement"]) == (3, pytest.approx(2 / 3))
    y = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1), (None, 0.5)], "y_true int, score double")
    got = {r["threshold"]: (r["vme"], r["me"]) for r in evaluation.error_curve(y).collect()}
    assert got == {0.1: (0.0, 1.0), 0.7: (0.0, 0.5), 0.8: (0.5, 0.5), 0.9: (0.5, 0.0)}
    rep = evaluation.report(spark.createDataFrame([(1, 0), (1, 1)], "y_true int, y_pred int")).first()
    assert rep["vme"] + rep["sensitivity"] == 1 and rep["me"] == 0


def test_corrections_against_plain_python(spark):
    p = [0.01, None, 0.04, 0.03, 0.5, float("nan")]
    df = spark.createDataFrame(list(enumerate(p)), "bin_index int, p_value double")
    got = {r["bin_index"]: r["adjusted_p_value"] for r in differential.corrected(df).collect()}
    known = sorted((v, i) for i, v in enumerate(p) if v is not None and v == v)
    best, want = 1.0, {1: 1.0, 5: 1.0}
    for rank in range(len(known), 0, -1):
        v, i = known[rank - 1]
        best = min(best, v * len(known) / rank)
        want[i] = best
    assert got == pytest.approx(want)


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0], [5.0, 4.0, 3.0, 2.0, 1.0], [0.0] * 5)], "a array<double>, b array<double>, z array<double>")
    r = df.select(similarity.pearson_distance(F.col("a"), F.col("b")).alias("p"), similarity.cosine_distance(F.col("a"), F.col("z")).alias("z"), similarity.contrast_angle(F.col("a"), F.col("a")).alias("s")).first()
    assert r["p"] == pytest.approx(2) and r["z"] == 1 and r["s"] == pytest.approx(0, abs=1e-7)

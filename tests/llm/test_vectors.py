import numpy as np
import pytest

from peakforge.llm import clusters, vectors


def planted(n=1500, dim=60, groups=220, seed=5, hot=0.33):
    rng = np.random.default_rng(seed)
    centres = np.abs(rng.normal(size=(groups, dim))) * (rng.random((groups, dim)) < 0.3)
    own = np.where(rng.random(n) < hot, 0, rng.integers(0, groups, n))
    return own, centres[own] + 0.06 * np.abs(rng.normal(size=(n, dim)))


def frame(spark, x, extra=()):
    rows = [(int(i + 1), [float(v) for v in r], "clash") for i, r in enumerate(x)] + [(*e, "clash") for e in extra]
    return spark.createDataFrame(rows, "spectrum_no bigint, x array<float>, id string")


def cosines(x):
    u = x.astype(np.float32).astype(float)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    return u @ u.T


@pytest.fixture(scope="module")
def table_(spark):
    _, x = planted()
    x[700:760] = x[3]  # copies
    x[-1] = 0
    x[-1, :2] = 1, 2  # shorter in the table, as if followed by zeros
    df = frame(spark, x, [(5001, None), (5002, [0.0] * 60), (5003, []), (None, [1.0] * 60)])
    return x, df.where(f"spectrum_no is null or spectrum_no <> {len(x)}").union(spark.createDataFrame([(len(x), [1.0, 2.0], "clash")], df.schema))


def brute(x, k=5, least=0.85):
    s = np.round(cosines(x), 9)
    out = {}
    for i in range(len(x)):
        c = [j for j in np.nonzero(s[i] >= least)[0] if j != i]
        c.sort(key=lambda j: (-s[i, j], j))
        out[i + 1] = [int(j) + 1 for j in c[:k]]
    return out


def test_neighbours_recall_and_order(table_):
    x, df = table_
    want = brute(x)
    got = {}
    for r in vectors.neighbours(df, "spectrum_no", "x", list_rows=50).collect():
        got.setdefault(r["query_no"], []).append((r["place"], r["other_no"]))
    got = {k: [o for _, o in sorted(v)] for k, v in got.items()}
    hits = sum(len(set(want[k]) & set(got.get(k, []))) for k in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    copies = [4, *range(701, 761)]
    for c in copies:
        assert got[c] == [k for k in copies if k != c][:5]


def test_neighbours_in_one_list_are_exact(spark):
    x = planted(400, 40, 30, 9)[1]
    df = frame(spark, x)
    got = {(r["query_no"], r["other_no"]) for r in vectors.neighbours(df, "spectrum_no", "x", list_rows=1000).collect()}
    assert got == {(k, o) for k, v in brute(x).items() for o in v}
    assert vectors.neighbours(df.limit(0), "spectrum_no", "x").count() == 0


def test_packed_vectors_lose_nothing():
    x = planted(300, 61, 40, 3)[1].astype(np.float32)
    x[5] = 0
    x[6, :3] = [-1.5, 3.4e38, 1e-42]
    assert (vectors.unpack(vectors.pack(x), 61) == x).all()
    assert vectors.unpack(vectors.pack(x[:0]), 61).shape == (0, 61)


def test_all_lists_within_reach_are_read(spark):
    # Noise without groups: nearly all of the 50 lists are about as near, and no number of lists may cut the search.
    x = np.random.default_rng(8).normal(size=(1000, 80))
    want = {k: v for k, v in brute(x, least=0.2).items() if v}
    found = {}
    for r in vectors.neighbours(frame(spark, x), "spectrum_no", "x", least=0.2, spread=9.0, reach=9.0, list_rows=20).collect():
        found.setdefault(r["query_no"], set()).add(r["other_no"])
    assert found == {k: set(v) for k, v in want.items()}


def test_graph_search_finds_the_nearest_list():
    # 750 lists are looked at all, 5,000 by the graph.
    x = vectors.unit(planted(10_000, 60, 2500, 4, 0)[1])
    lists = vectors.Lists.fit(x, 10_000, 2)
    assert len(lists.centroids) > 8 * lists.links.shape[1]
    x = x[:3000]
    assert (lists.search(x).argmax(axis=1) == (x.astype(np.float32) @ lists.centroids.T).argmax(axis=1)).mean() > 0.9
    lists = vectors.Lists.fit(x, 30_000, 40)
    assert (lists.search(x).argmax(axis=1) == (x.astype(np.float32) @ lists.centroids.T).argmax(axis=1)).mean() > 0.9


def test_merge_block_is_average_linkage():
    rng = np.random.default_rng(0)
    x = vectors.unit(np.abs(rng.normal(size=(30, 6))))
    root, other, _ = clusters.merge_block(np.arange(30), np.ones(30, int), x.copy(), 0.9)
    assert (other == -1).all()
    live = {i: [i] for i in range(30)}
    while True:  # plain average linkage, one pair at a time; reciprocal pairs give the same tree
        best = max(((np.mean([x[a] @ x[b] for a in live[i] for b in live[j]]), -i, -j) for i in live for j in live if i < j), default=(0, 0, 0))
        if best[0] < 0.9:
            break
        live[-best[1]] += live.pop(-best[2])
    assert {frozenset(v) for v in live.values()} == {frozenset(np.nonzero(root == r)[0]) for r in set(root)}


def test_clusters_equal_the_groups_of_the_threshold(spark, table_):
    x, df = table_
    s = cosines(x)
    first = (s >= 0.85).argmax(axis=1)
    assert ((s >= 0.85) == (first[:, None] == first[None, :])).all(), "planted groups must be clear"
    member, sums = clusters.clusters(df, "spectrum_no", "x", list_rows=40)
    got = {r["id"]: r["cluster_no"] for r in member.collect()}
    assert got == {i + 1: int(first[i]) + 1 for i in range(len(x))}
    assert sum(r["n"] for r in sums.select("n").collect()) == len(x)
    top = clusters.typical(df, "spectrum_no", "x", member, sums.where("n > 1")).where("place = 1").collect()
    assert len(top) == sum(n > 1 for n in np.bincount(first))


def partition(member):
    groups = {}
    for r in member.collect():
        groups.setdefault(r["cluster_no"], set()).add(r["id"])
    assert all(k == min(v) for k, v in groups.items())
    return {frozenset(v) for v in groups.values()}


@pytest.mark.parametrize("list_rows,block", [(20, 2000), (100, 150), (1000, 2000)])
def test_vectors_without_gaps_give_average_linkage_whatever_the_lists(spark, list_rows, block):
    # With all lists within the spread nothing is lost to pruning, and neither lists nor blocks may show in the result.
    x = np.cumsum(np.random.default_rng(1).normal(size=(600, 30)), axis=1).astype(np.float32).astype(float)
    root, _, _ = clusters.merge_block(np.arange(1, 601), np.ones(600, int), vectors.unit(x), 0.85)
    want = {frozenset(int(i) + 1 for i in np.nonzero(root == r)[0]) for r in set(root)}
    member, _ = clusters.clusters(frame(spark, x), "spectrum_no", "x", list_rows=list_rows, block=block, spread=99.0)
    assert partition(member) == want


def test_frozen_rows_do_not_merge_but_count_as_partners():
    x = vectors.unit(np.array([[1.0, 0.0], [1.0, 0.01], [1.0, 0.3], [0.0, 1.0]]))
    root, other, _ = clusters.merge_block(np.arange(4), np.ones(4, int), x, 0.5, np.array([True, False, True, True]))
    assert root.tolist() == [0, 1, 2, 3] and other[:2].tolist() == [1, 0] and other[3] == -1


def test_a_hot_list_is_cut_into_cells(spark):
    own, x = planted(1500, 60, 50, 6, 0.5)
    want = {(k, o) for k, v in brute(x).items() for o in v}
    got = {(r["query_no"], r["other_no"]) for r in vectors.neighbours(frame(spark, x), "spectrum_no", "x", list_rows=5000, block=100).collect()}
    assert got == want
    lists = vectors.Lists.fit(vectors.unit(x), 1500, 5000, 100)
    ids = np.arange(1500)
    r, c, own, cell = lists.cells(ids, lists.within(vectors.unit(x), 1.04)[0])
    assert max(np.bincount(cell)) <= 250 and len(r) == 1500 * lists.blocks[0]
    # Any two blocks meet in exactly one cell.
    meet = [frozenset(own[cell == k]) for k in set(cell)]
    assert len(meet) == len(set(meet)) == lists.blocks[0] * (lists.blocks[0] + 1) // 2


def test_no_vector_at_all(spark):
    empty = spark.createDataFrame([], "spectrum_no bigint, x array<float>")
    assert clusters.clusters(empty, "spectrum_no", "x")[0].count() == 0
    only_zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "spectrum_no bigint, x array<float>")
    assert clusters.clusters(only_zero, "spectrum_no", "x")[0].count() == 0
    assert vectors.neighbours(only_zero, "spectrum_no", "x").count() == 0


def test_parts_of_several_lists_merge_at_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.repeat(vectors.unit(rng.normal(size=(12, 30))), 25, axis=0) + 0.03 * rng.normal(size=(300, 30))
    rounds, one = [], clusters._round
    monkeypatch.setattr(clusters, "_round", lambda *a: (rounds.append(1), one(*a))[1])
    member, _ = clusters.clusters(frame(spark, x), "spectrum_no", "x", list_rows=20, spread=1.5)
    found = {}
    for r in member.collect():
        found.setdefault(r["cluster_no"], []).append(r["id"])
    assert sorted(map(len, found.values())) == [25] * 12 and all(max(v) - min(v) == 24 for v in found.values())
    assert len(rounds) <= 2

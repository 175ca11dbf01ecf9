"""Clusters of mutually similar vectors by reciprocal-nearest-neighbour average linkage.

A cluster is kept as its size and the mean of its unit vectors, which gives the average similarity of two clusters exactly.
Clusters that may be near lie in one posting list (see ``vectors``), which makes the graph sparse: a cluster is posted to
every list within ``spread`` of its nearest one. Two rows of a list that are similar are linked, and links join rows into parts.
The average similarity of two clusters is never above the best of their pairs, so clusters grow within a part only: each part of
at most ``block`` rows is gathered in one place and merged there to the end. What is left, and larger parts row by row, goes
through rounds: a cluster's best partner is the best one over all its lists, and all mutual best pairs merge. A cluster posted to one list alone has all its partners there; so have the clusters it merges into, since the
average similarity to a merged pair is never above the better one of the two. Such clusters therefore merge on within their
list for as long as they are each other's best, clusters posted elsewhere too being compared but left as they are.
A cluster without a partner rests; when no pair is left, all clusters are searched again on fresh lists, and the end is a
search over all clusters that finds no pair. No pair merges that is best in a part of the data only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakforge.llm.components import components
from peakforge.llm.vectors import Lists, pack, sample_rows, set_aside, tasks_of, to_matrix, unit, unpack, usable
from peakforge.session import drop_shared, fitting, release, write_shared

LEAST = 0.85
LIST_ROWS, BLOCK = 400, 3_000
#: Distance ratio up to which a cluster is posted to further lists.
SPREAD = 1.04

_ROUND = "id bigint, root bigint, n bigint, x binary, other bigint, sim double"


def _lots(ids: np.ndarray) -> np.ndarray:
    """A number for each id by which equal similarities are told apart."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(float) / 1024.0


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers below 1e-10, one for each pair of ids, the same in any place: equally similar pairs are taken in a random order, else they would merge one by one."""
    out = np.outer(_lots(a), _lots(b))
    out -= np.floor(out)
    out *= 1e-10
    return out


def _parts(mean: np.ndarray, least: float, first: np.ndarray | None = None) -> np.ndarray:
    """Number of the part each row belongs to: rows joined by chains of similarities of at least ``least``, named after their first row; -1 for rows alone.

    An average similarity is never above the best of its pairs, so clusters grow within a part only. Single precision is off by less than 1e-4.
    Given ``first``, only its rows are compared, and only with the others.
    """
    rough, ends = mean.astype(np.float32), [np.zeros((2, 0), int)]
    p, q = (np.arange(len(mean)),) * 2 if first is None else (np.nonzero(first)[0], np.nonzero(~first)[0])
    for at in range(0, len(p), 1000):
        rest = q[at:] if first is None else q
        i, j = np.nonzero(rough[p[at : at + 1000]] @ rough[rest].T >= least - 1e-4)
        i, j = p[at + i], rest[j]
        ends.append(np.stack([i, j])[:, i != j if first is not None else i < j])
    i, j = np.concatenate(ends, axis=1)
    part = np.arange(len(mean))
    while len(i):
        low = np.minimum(part[i], part[j])
        if (part[i] == low).all() and (part[j] == low).all():
            break
        np.minimum.at(part, i, low)
        np.minimum.at(part, j, low)
        part = part[part]
    alone = np.ones(len(mean), bool)
    alone[i] = alone[j] = False
    part[alone] = -1
    return part


def merge_stack(sim: np.ndarray, w: np.ndarray, may: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(root, other, best) of a stack of k matrices of m similarities, -2 on the diagonal: all mutual best pairs of rows that ``may`` merge, round by round.

    A merged pair lives on as its earlier row. The average similarity to it is the weighted mean of the two, so matrices are updated, not recomputed.
    """
    k, m, _ = sim.shape
    root, at, every = np.tile(np.arange(m), (k, 1)), np.arange(m)[None, :], np.arange(k)[:, None]
    while True:
        other = sim.argmax(axis=2)
        best = np.take_along_axis(sim, other[:, :, None], axis=2)[:, :, 0]
        hit = (np.take_along_axis(other, other, axis=1) == at) & (at < other) & (best >= least) & may & may[every, other]
        z, a = np.nonzero(hit)
        if not len(z):
            break
        b = other[z, a]
        wa, wb = w[z, a][:, None], w[z, b][:, None]
        sim[z, a] = (wa * sim[z, a] + wb * sim[z, b]) / (wa + wb)
        sim[z, :, a] = (wa * sim[z, :, a] + wb * sim[z, :, b]) / (wa + wb)
        sim[z, b], sim[z, :, b], sim[z, a, a] = -2.0, -2.0, -2.0
        w[z, a] += w[z, b]
        root[z, b] = a
        while (np.take_along_axis(root, root, axis=1) != root).any():
            root = np.take_along_axis(root, root, axis=1)
    return root, np.where(best >= least, other, -1), best


def merge_block(ids: np.ndarray, n: np.ndarray, mean: np.ndarray, least: float, sole: np.ndarray | None = None, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(root, other, sim): position of the cluster each row ends in, and position and similarity of the best partner of each cluster left (-1: none).

    Rows must be in ascending order of ``ids``. All mutual best pairs of ``sole`` rows (default: all) merge per round while they reach
    ``least``. Parts without similarities between them (``part``, if known: their numbers, -1 for rows alone) are worked on by
    themselves, small ones of like size in one stack.
    """
    root, other, found = np.arange(len(ids)), np.full(len(ids), -1), np.full(len(ids), -2.0)
    may = np.ones(len(ids), bool) if sole is None else sole
    if part is None:
        part = _parts(mean, least) if len(ids) else np.zeros(0, int)
    order = np.argsort(part, kind="stable")[(part == -1).sum() :]
    starts = np.nonzero(np.diff(part[order], prepend=-1))[0]
    sizes = np.diff(np.append(starts, len(order)))
    width = 2 ** np.ceil(np.log2(np.maximum(sizes, 2))).astype(int)
    width[sizes > 64] = sizes[sizes > 64]
    for m in np.unique(width):
        mine = np.nonzero(width == m)[0]
        step = max(1, 4_000_000 // m**2)
        for at in range(0, len(mine), step):
            some = mine[at : at + step]
            spot = starts[some][:, None] + np.arange(m)[None, :]
            real = np.arange(m)[None, :] < sizes[some][:, None]
            rows = order[np.where(real, spot, starts[some][:, None])]
            lots = _lots(ids[rows])
            sim = lots[:, :, None] * lots[:, None, :]
            sim -= np.floor(sim)
            sim *= 1e-10
            sim += mean[rows] @ mean[rows].transpose(0, 2, 1)
            sim[~(real[:, :, None] & real[:, None, :])] = -2.0
            sim[:, np.arange(m), np.arange(m)] = -2.0
            to, near, best = merge_stack(sim, n[rows].astype(float), may[rows] & real, least)
            root[rows[real]] = np.take_along_axis(rows, to, axis=1)[real]
            hit = (near >= 0) & real
            other[rows[hit]], found[rows[hit]] = np.take_along_axis(rows, np.maximum(near, 0), axis=1)[hit], best[hit]
    return root, other, found


def _posts(clusters: DataFrame, dim: int, most: int | None, seed: int, list_rows: int, block: int, spread: float) -> tuple[DataFrame, Lists, int]:
    """(posts, lists, rows): every cluster in the cells of its lists, the lists fitted on a sample, and about how many clusters there are."""
    sample, rows = sample_rows(clusters, "id", "x", dim, most)
    lists = Lists.fit(sample, rows, list_rows if rows > min(block, 8 * list_rows) else block, block, seed, spread, spread)
    shared = clusters.sparkSession.sparkContext.broadcast(vars(lists))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Lists(**shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                ids, n = part.column("id").to_numpy(), part.column("n").to_numpy()
                m = to_matrix(part.column("x"), dim)
                (near,) = index.within(unit(m), spread)
                r, c, own, cell = index.cells(ids, near)
                sole = (index.blocks[c] == 1) & (near.sum(axis=1) == 1)[r]
                # One of a row's copies brings it into the next round.
                home = np.zeros(len(r), bool)
                home[np.unique(r, return_index=True)[1]] = True
                columns = [pa.array(v) for v in (c.astype(np.int32), cell.astype(np.int32), own.astype(np.int32), index.blocks[c] == 1, sole, home, ids[r], n[r])]
                yield pa.RecordBatch.from_arrays([*columns, pack(m.astype(np.float32)).take(pa.array(r))], ["list", "cell", "block", "whole", "sole", "home", "id", "n", "x"])

    posts = clusters.select("id", "n", "x").mapInArrow(post, "list int, cell int, block int, whole boolean, sole boolean, home boolean, id bigint, n bigint, x binary")
    return posts, lists, rows


def _outcome(ids: np.ndarray, n: np.ndarray, mean: np.ndarray, root: np.ndarray, other: np.ndarray, sim: np.ndarray, home: np.ndarray) -> pa.Table:
    """Rows of ``_ROUND``: (id, root) of rows merged, (id, n, x) of ``home`` clusters left, (id, other, sim) of best partners; the means of merged rows are replaced."""
    top, total = root == np.arange(len(ids)), np.zeros(len(ids), np.int64)
    np.add.at(total, root, n)
    gone, left, some = np.nonzero(~top)[0], np.nonzero(top & home)[0], np.nonzero(other >= 0)[0]
    grown = np.nonzero(np.isin(root, root[gone]))[0]
    grown = grown[np.argsort(root[grown], kind="stable")]
    heads, first = np.unique(root[grown], return_index=True)
    if len(heads):
        mean[heads] = np.add.reduceat(mean[grown] * n[grown][:, None], first) / total[heads][:, None]
    k, l_, m = len(gone), len(left), len(some)
    none = lambda size, kind: pa.nulls(size, kind)
    return pa.table({
        "id": pa.array(np.concatenate([ids[gone], ids[left], ids[some]])),
        "root": pa.concat_arrays([pa.array(ids[root[gone]]), none(l_ + m, pa.int64())]),
        "n": pa.concat_arrays([none(k, pa.int64()), pa.array(total[left]), none(m, pa.int64())]),
        "x": pa.concat_arrays([none(k, pa.binary()), pack(mean[left].astype(np.float32)), none(m, pa.binary())]),
        "other": pa.concat_arrays([none(k + l_, pa.int64()), pa.array(ids[other[some]])]),
        "sim": pa.concat_arrays([none(k + l_, pa.float64()), pa.array(sim[some])]),
    })


def _links(vectors: DataFrame, dim: int, seed: int, list_rows: int, block: int, least: float, spread: float) -> tuple[DataFrame, int]:
    """((a, b, inside), number of vectors): each vector with the first one of its part of a list; ``inside`` if the part lies in this list alone."""
    posts, lists, rows = _posts(vectors, dim, None, seed, list_rows, block, spread)

    def work(table: pa.Table) -> pa.Table:
        ids, own, sole = (table.column(c).to_numpy() for c in ("id", "block", "sole"))
        first = own == own.min()
        part = _parts(unit(unpack(table.column("x"), dim).astype(np.float64)), least, None if first.all() else first)
        some = np.nonzero(part >= 0)[0]
        inside = np.ones(len(ids), bool)
        np.logical_and.at(inside, part[some], sole[some])
        return pa.table({"a": pa.array(ids[some]), "b": pa.array(ids[part[some]]), "inside": pa.array(inside[part[some]])})

    posts = posts.select("list", "cell", "block", "sole", "id", "x").repartition(tasks_of(vectors.sparkSession, lists.rows, 50 + dim), "list", "cell")
    return posts.groupBy("list", "cell").applyInArrow(work, "a bigint, b bigint, inside boolean"), rows


def _gathered(vectors: DataFrame, parts: DataFrame, dim: int, rows: int, block: int, least: float) -> DataFrame:
    """``_ROUND`` of about ``rows`` vectors after each of ``parts`` (node, component) has merged to the end in one place; other vectors stay as they are."""
    keyed = vectors.join(fitting(parts), F.col("id") == F.col("node"), "left")
    keyed = keyed.select(F.pmod(F.xxhash64(F.coalesce("component", "id")), F.lit(rows // block + 1)).cast("int").alias("lot"), F.coalesce("component", F.lit(-1)).alias("part"), F.col("component").isNotNull().alias("joined"), "id", "n", "x")

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pack(to_matrix(b.column("x"), dim).astype(np.float32))], b.schema.names)

    def work(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("id").to_numpy(), kind="stable")))
        ids, n, joined = (table.column(c).to_numpy() for c in ("id", "n", "joined"))
        mean = unit(unpack(table.column("x"), dim).astype(np.float64))
        part = np.where(joined, np.unique(table.column("part").to_numpy(), return_inverse=True)[1], -1)
        root, other, sim = merge_block(ids, n, mean, least, None, part)
        return _outcome(ids, n, mean, root, np.full(len(other), -1), sim, np.ones(len(ids), bool))

    keyed = keyed.mapInArrow(dense, "lot int, part bigint, joined boolean, id bigint, n bigint, x binary")
    return keyed.repartition(tasks_of(vectors.sparkSession, rows, 40 + dim), "lot").groupBy("lot").applyInArrow(work, _ROUND)


def _round(clusters: DataFrame, dim: int, most: int, seed: int, list_rows: int, block: int, least: float, spread: float) -> tuple[DataFrame, int]:
    """One row (id, root) per merged cluster, one (id, n, x) per cluster left, one (id, other, sim) per list in which a cluster left has a partner.

    ``most`` is a number the clusters don't exceed; with it comes about how many they are.
    """
    posts, lists, rows = _posts(clusters, dim, most, seed, list_rows, block, spread)

    def work(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        table = table.take(pa.array(np.argsort(ids, kind="stable")))
        ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
        own, whole, sole, home = (table.column(c).to_numpy() for c in ("block", "whole", "sole", "home"))
        mean = unpack(table.column("x"), dim).astype(np.float64)
        mean[n == 1] = unit(mean[n == 1])
        if whole.all():
            root, other, sim = merge_block(ids, n, mean, least, sole)
        else:
            # A cell of a list that is cut into blocks: partners are looked up, nothing merges here.
            root, other, sim = np.arange(len(ids)), np.full(len(ids), -1), np.full(len(ids), -2.0)
            first, rough = own == own.min(), mean.astype(np.float32)
            p, q = np.nonzero(first)[0], np.arange(len(ids)) if first.all() else np.nonzero(~first)[0]
            for at in range(0, len(p) if len(q) else 0, 1000):
                i = p[at : at + 1000]
                near = rough[i] @ rough[q].T >= least - 1e-4
                near[ids[i][:, None] == ids[q][None, :]] = False
                i, j = i[near.any(axis=1)], q[near.any(axis=0)]
                if not len(i):
                    continue
                s = mean[i] @ mean[j].T + _apart(ids[i], ids[j])
                s[ids[i][:, None] == ids[j][None, :]] = -2.0
                for mine, theirs, m in ((i, j, s), (j, i, s.T))[: 1 if first.all() else 2]:
                    o = m.argmax(axis=1)
                    v = m[np.arange(len(mine)), o]
                    some = (v >= least) & (v > sim[mine])
                    other[mine[some]], sim[mine[some]] = theirs[o[some]], v[some]
        return _outcome(ids, n, mean, root, other, sim, home)

    posts = posts.repartition(tasks_of(clusters.sparkSession, lists.rows, 60 + dim), "list", "cell")
    return posts.groupBy("list", "cell").applyInArrow(work, _ROUND), rows


def _merged(members: DataFrame, dim: int) -> DataFrame:
    """Clusters (id, n, x) made of the two rows (to, n, x) of each ``to``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n, n2 = b.column("n").to_numpy(), b.column("n2").to_numpy()
                x, x2 = (unpack(b.column(c), dim).astype(np.float64) for c in ("x", "x2"))
                x[n == 1], x2[n2 == 1] = unit(x[n == 1]), unit(x2[n2 == 1])
                mean = (x * n[:, None] + x2 * n2[:, None]) / (n + n2)[:, None]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n + n2), pack(mean.astype(np.float32))], ["id", "n", "x"])

    two = members.groupBy("to").agg(F.collect_list(F.struct("n", "x")).alias("v"))
    a, b = F.get("v", F.lit(0)), F.get("v", F.lit(1))
    return two.select(F.col("to").alias("id"), a["n"].alias("n"), a["x"].alias("x"), b["n"].alias("n2"), b["x"].alias("x2")).mapInArrow(add, "id bigint, n bigint, x binary")


def clusters(vectors: DataFrame, key: str, x: str, least: float = LEAST, list_rows: int = LIST_ROWS, block: int = BLOCK, spread: float = SPREAD) -> tuple[DataFrame, DataFrame]:
    """((id, cluster_no), (id, n, x)): membership of every usable vector, and size and packed mean unit vector of every cluster.

    A cluster is named after its smallest key; a vector without a partner is a cluster of its own. Null, empty and zero vectors
    belong to none; a shorter vector counts as followed by zeros. Equal vectors are one cluster from the start; equally similar pairs
    merge in the order of a hash of their keys. An empty table gives empty results.
    """
    rows, dim = usable(vectors, key, x)
    firsts, spare, groups = set_aside(rows, 1)
    counted = groups.select(F.col("first").alias("id"), F.col("n").alias("m"))
    active = firsts.join(fitting(counted), "id", "left").select("id", F.coalesce("m", F.lit(1)).cast("bigint").alias("n"), "x")
    # Parts that are small enough merge to the end first; the lists of the rounds are others than those that gave the parts.
    links, total = _links(active, dim, 1, list_rows, block, least, spread)
    links = write_shared(links, "links")
    release(vectors.sparkSession)
    crossing = components(links.where("not inside").select("a", "b"))
    parts = write_shared(links.where("inside").select(F.col("a").alias("node"), F.col("b").alias("component")).union(crossing), "parts")
    large = write_shared(parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("component"), "large")
    parts_ = parts if large.isEmpty() else write_shared(parts.join(fitting(large), "component", "left_anti").select("node", "component"), "parts")
    turn = write_shared(_gathered(active, parts_, dim, total, block, least), "gathered")
    release(vectors.sparkSession)
    steps = [write_shared(turn.where("root is not null").select(F.col("id").alias("from"), F.col("root").alias("to")), "step")]
    resting, read, seed, whole, most = [], [turn], 1, True, total
    active, rests = turn.where("x is not null").select("id", "n", "x"), not large.isEmpty()
    for t in (links, parts, large, *[parts_] * (parts_ is not parts)):
        drop_shared(t)
    while True:
        seed += 1
        plan, most = _round(active, dim, most, seed, list_rows, block, least, spread)
        turn = write_shared(plan, "round")
        release(vectors.sparkSession)
        best = turn.where("other is not null").groupBy("id").agg(F.max_by("other", F.struct("sim", -F.col("other"))).alias("other"))
        best = write_shared(best, "best")
        # Clusters that have a partner go on, merged with it where the choice is mutual; the others rest.
        back = best.select(F.col("id").alias("other"), F.col("other").alias("back"))
        target = best.join(fitting(back), "other", "left").select("id", F.when(F.col("back") == F.col("id"), F.least("id", "other")).alias("to"))
        target = write_shared(target, "targets")
        drop_shared(best)
        met = target.where("to < id").select(F.col("id").alias("root"), "to")
        local = turn.where("root is not null").select("id", "root")
        step = local.join(fitting(met), "root", "left").select(F.col("id").alias("from"), F.coalesce("to", "root").alias("to")).union(met.select(F.col("root").alias("from"), "to"))
        step = write_shared(step, "step")
        ended, still = met.isEmpty(), step.isEmpty()
        left = turn.where("x is not null").select("id", "n", "x")
        if whole and still:
            break
        steps.append(step)
        merged = write_shared(_merged(left.join(fitting(target.where("to is not null")), "id"), dim), "merged")
        now = left.join(fitting(target.where("to is null").select("id")), "id", "left_semi").union(merged)
        resting.append(left.join(fitting(target.select("id")), "id", "left_anti"))
        read += [turn, target, merged]
        whole = ended or (whole and (seed > 2 or not rests))
        if whole:  # nothing merges any more among these, or little did among all: all clusters are searched again
            now, most = write_shared(reduce(DataFrame.union, [now, *resting]), "all"), total
            for t in read:
                drop_shared(t)
            read, resting = [now], []
        active = now
    member = rows.select("id").join(fitting(spare), "id", "left").select("id", F.coalesce("first", "id").alias("root"))
    for step in steps:
        member = member.join(fitting(step), F.col("root") == F.col("from"), "left").select("id", F.coalesce("to", "root").alias("root"))
    return member.select("id", F.col("root").alias("cluster_no")), left


def typical(vectors: DataFrame, key: str, x: str, member: DataFrame, means: DataFrame, most: int = 3) -> DataFrame:
    """(cluster_no, size, place, id, similarity): the members nearest to the average of their cluster; ties to the smaller key.

    Members are scored where they lie, with one equality join on the cluster; only each partition's best reach the merge.
    """
    rows, dim = usable(vectors, key, x)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat = unpack(b.column("x"), dim)
                one = b.column("n").to_numpy() == 1
                flat[one] = unit(flat[one].astype(np.float64))
                lists = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, dim, dtype=np.int32), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), lists], ["cluster_no", "size", "c"])

    centres = means.select("id", "n", "x").mapInArrow(dense, "cluster_no bigint, size bigint, c array<float>")
    rows = rows.join(member, "id").join(centres, "cluster_no")
    v = F.transform("x", lambda v: F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0)))
    dot = F.aggregate(F.zip_with("x", "c", lambda a, b: F.coalesce(a, F.lit(0.0)).cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, v: s + v * v))
    scored = rows.select("cluster_no", "size", "id", F.round(dot / norm, 6).alias("similarity"))
    w = Window.partitionBy("cluster_no").orderBy(F.desc("similarity"), "id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)

"""Most similar vectors for every vector by balanced posting lists.

A bounded sample gives the centroids: sampled vectors, moved twice to the mean of their share, so that dense regions get
as many lists as they need. The centroids lie in memory as a graph, whose pivots lead to their nearest centroids. A vector
is posted to its nearest list and to every list whose distance is within ``spread`` of that; a query reads all lists
within ``reach`` of its nearest one, however many. A list is worked off as a grid: it is cut into blocks of bounded size, and
any two blocks meet in one cell. Vectors travel packed without loss. All vectors are indexed, all are queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakforge.session import drop_shared, fitting, write_shared

#: Rows of the sample on which the lists are fitted, at most; the driver holds it. It bounds the centroids too: lists of more rows are cut into more blocks.
SAMPLE = 20_000
#: Vectors a list should hold, rows of a block.
LIST_ROWS, BLOCK = 400, 4_000
#: Distance ratios up to which further lists take a vector and up to which a query reads further lists.
SPREAD, REACH = 1.05, 1.06
#: Distance ratio up to which a search of the graph starts from further pivots.
START = 1.15
#: Bytes a task should read.
TASK_BYTES = 8_000_000
#: Rows below which a task isn't worth its start.
TASK_ROWS = 5_000


def to_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column (or of cells of ``pack``) as float64 matrix; shorter rows are followed by zeros, nulls and infinities inside count as 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, dim))
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return unpack(column, dim).astype(np.float64)
    flat = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), nan=0.0, posinf=0.0, neginf=0.0)
    if len(flat) == dim * len(column):
        sizes = np.diff(column.offsets.to_numpy())
        if (sizes == dim).all():
            return flat.reshape(-1, dim)
    out = np.zeros((len(column), dim))
    sizes = np.diff(column.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[row]] = flat
    return out


def pack(m: np.ndarray) -> pa.Array:
    """Rows of a float32 matrix without loss as binary: which numbers aren't 0, then the bytes of those numbers plane by plane, which shuffles and tables compress."""
    some, dim = m != 0, m.shape[1]
    head, k = -(-dim // 8), some.sum(axis=1)
    size = head + 4 * k
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(start[-1], np.uint8)
    out[(start[:-1, None] + np.arange(head)).ravel()] = np.packbits(some, axis=1).ravel()
    numbers = np.ascontiguousarray(m[some]).view(np.uint8).reshape(-1, 4)
    at = np.repeat(start[:-1] + head - (np.cumsum(k) - k), k) + np.arange(len(numbers))
    step = np.repeat(k, k)
    for i in range(4):
        out[at] = numbers[:, 3 - i]
        at += step
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(start.astype(np.int32)), pa.py_buffer(out)])


def unpack(cells: pa.Array, dim: int) -> np.ndarray:
    """The float32 matrix behind cells of ``pack``."""
    if isinstance(cells, pa.ChunkedArray):
        cells = pa.concat_arrays(cells.chunks) if cells.num_chunks else pa.array([], pa.binary())
    out = np.zeros((len(cells), dim), np.float32)
    if not len(cells):
        return out
    if cells.offset or not pa.types.is_binary(cells.type):
        cells = pa.concat_arrays([cells.cast(pa.binary()), pa.array([], pa.binary())])
    start = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1].astype(np.int64)
    data = np.frombuffer(cells.buffers()[2], np.uint8)
    head = -(-dim // 8)
    some = np.unpackbits(data[start[:-1, None] + np.arange(head)], axis=1, count=dim).astype(bool)
    k = some.sum(axis=1)
    numbers = np.empty((k.sum(), 4), np.uint8)
    at = np.repeat(start[:-1] + head - (np.cumsum(k) - k), k) + np.arange(len(numbers))
    step = np.repeat(k, k)
    for i in range(4):
        numbers[:, 3 - i] = data[at]
        at += step
    out[some] = numbers.view(np.float32)[:, 0]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1.0)


def _distance(sims: np.ndarray) -> np.ndarray:
    """Distances of unit vectors, in the place of their similarities."""
    sims *= -2
    sims += 2
    np.maximum(sims, 0, out=sims)
    return np.sqrt(sims, out=sims)


@dataclass
class Lists:
    """Centroids of the posting lists, the graph over them, and the number of blocks each list is cut into; ``rows`` estimates the rows of all cells."""

    centroids: np.ndarray
    pivots: np.ndarray
    links: np.ndarray
    blocks: np.ndarray
    rows: float

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, list_rows: int = LIST_ROWS, block: int = BLOCK, seed: int = 7, spread: float = SPREAD, reach: float = REACH) -> Lists:
        """Fit on unit vectors ``sample`` drawn from ``rows`` rows."""
        sample = sample.astype(np.float32)
        rng = np.random.default_rng(seed)
        n = int(np.clip(-(-rows // list_rows), 1, max(1, len(sample) // 2)))
        c = sample[rng.permutation(len(sample))[:n]] if len(sample) else np.zeros((1, 1), np.float32)
        steps = range(0, len(sample), 2000)
        for _ in range(2):
            own = np.concatenate([np.argmax(sample[i : i + 2000] @ c.T, axis=1) for i in steps] or [np.zeros(0, int)])
            sums = np.zeros_like(c)
            np.add.at(sums, own, sample)
            full = np.linalg.norm(sums, axis=1) > 0
            c[full] = unit(sums[full])
        p = min(len(c), int(2 * np.sqrt(len(c))) + 1)
        pivots = rng.permutation(len(c))[:p]
        m = min(len(c), max(64, 16 * len(c) // p))
        near = c[pivots] @ c.T
        links = np.argpartition(-near, m - 1, axis=1)[:, :m] if m < len(c) else np.tile(np.arange(len(c)), (p, 1))
        out = cls(c, pivots, links, np.ones(len(c), int), 0.0)
        held = np.zeros(len(c))
        for i in steps:
            held += out.within(sample[i : i + 2000], max(spread, reach))[0].sum(axis=0)
        held *= rows / max(1, len(sample))
        out.blocks = np.maximum(1, np.ceil(held / block)).astype(int)
        out.rows = float((held * out.blocks).sum())
        return out

    def search(self, x: np.ndarray) -> np.ndarray:
        """Similarity of each row to the centroids the graph leads to; -2 for those it doesn't reach."""
        x = x.astype(np.float32)
        if len(self.centroids) <= 8 * self.links.shape[1]:
            return x @ self.centroids.T  # few enough that walking the graph would cost more than looking at all
        sims = np.full((len(x), len(self.centroids)), -2.0, np.float32)
        d = _distance(x @ self.centroids[self.pivots].T)
        starts = d <= d.min(axis=1, keepdims=True) * START + 1e-7
        for p in np.nonzero(starts.any(axis=0))[0]:
            rows = np.nonzero(starts[:, p])[0]
            sims[np.ix_(rows, self.links[p])] = x[rows] @ self.centroids[self.links[p]].T
        return sims

    def within(self, x: np.ndarray, *ratios: float) -> list[np.ndarray]:
        """For each ratio, which lists are at most that multiple of the nearest list's distance away from each row."""
        d = _distance(self.search(x))
        best = d.min(axis=1, keepdims=True)
        return [d <= best * np.float32(r) + np.float32(1e-7) for r in ratios]

    def cells(self, ids: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, list, block, cell): every row in the cells (two blocks) of its lists' grids."""
        r, c = np.nonzero(near)
        g = self.blocks[c]
        own = (ids[r].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % g
        rep = np.repeat(np.arange(len(r)), g)
        other = np.arange(len(rep)) - np.repeat(np.cumsum(g) - g, g)
        cell = np.minimum(own[rep], other) * g[rep] + np.maximum(own[rep], other)
        return r[rep], c[rep], own[rep], cell


def tasks_of(spark, rows: float, row_bytes: int) -> int:
    """Partitions for ``rows`` rows, so that a task reads about TASK_BYTES; as many as the session shuffles into, if there are enough rows for them."""
    return max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(rows / TASK_ROWS) + 1), int(rows * row_bytes / TASK_BYTES) + 1)


def sample_rows(vectors: DataFrame, key: str, x: str, dim: int, n: int | None = None, most: int = SAMPLE) -> tuple[np.ndarray, int]:
    """(unit sample, number of rows): rows chosen by a hash of the key, about ``most`` at most.

    Rows are counted, unless ``n``, a number they don't exceed, is given; then the sample tells how many they are about.
    """
    limit, counted = (vectors.count(), True) if n is None else (n, False)
    part, share = vectors.select(key, x), 1.0
    if limit > most:
        share = int(1_000_000 * most / limit) / 1_000_000
        part = part.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * share))
    sample = unit(to_matrix(part.select(x).toArrow().column(0), dim))
    return sample, limit if counted else min(limit, -int(-len(sample) // share))


def usable(vectors: DataFrame, key: str, x: str) -> tuple[DataFrame, int]:
    """(rows (id, x), length): rows whose vector is neither null nor empty nor all zero nor without key, and the greatest length.

    A shorter vector counts as followed by zeros. Nulls inside a vector count as 0.
    """
    v = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(x).alias("x")).where(F.col(key).isNotNull() & F.exists(x, lambda v: (v != 0) & ~F.isnan(v)))
    return v, int(v.agg(F.max(F.size("x"))).first()[0] or 1)


def set_aside(rows: DataFrame, keep: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows kept, copies (id, first), groups (first, n)): of equal vectors only the ``keep`` smallest ids stay, the others point to the smallest.

    Each partition passes on ``keep`` rows of a group at most, so a group of any size is folded before the shuffle.
    """
    marks = write_shared(rows.select("id", F.xxhash64("x").alias("h"), F.hash("x").alias("g")), "marks")
    groups = marks.groupBy("h", "g").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > keep)
    groups = write_shared(groups, "groups")
    many = marks.join(fitting(groups), ["h", "g"]).select("h", "g", "id", "first")
    stay = many.withColumn("place", F.row_number().over(Window.partitionBy("h", "g").orderBy("id"))).where(F.col("place") <= keep)
    spare = write_shared(many.join(stay.select("id"), "id", "left_anti").select("id", "first"), "copies")
    drop_shared(marks)
    return rows.join(fitting(spare.select("id")), "id", "left_anti"), spare, groups


def _best(r: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row ``r``: similarities rounded to 9 decimals, ties to the smaller id."""
    order = np.lexsort((ids, -sims, r))
    sorted_ = r[order]
    first = np.concatenate([[True], sorted_[1:] != sorted_[:-1]]) if len(order) else np.zeros(0, bool)
    at = np.arange(len(order))
    return order[at - np.maximum.accumulate(np.where(first, at, 0)) < k]


def similar(u: np.ndarray, rough: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, similarity) of the rows ``a`` and ``b`` of u that are similar by ``least`` at 9 decimals.

    ``rough`` is u in single precision, off by less than 1e-4: it sets aside pairs without a chance, nothing else.
    """
    hit = rough[a] @ rough[b].T >= least - 1e-4
    i, j = np.nonzero(hit)
    if len(i) * 8 > hit.size:
        s = (u[a] @ u[b].T)[i, j]
    else:
        s = np.einsum("ij,ij->i", u[a[i]], u[b[j]]) if len(i) else np.zeros(0)
    s = np.round(s, 9)
    keep = s >= least - 5e-10
    return a[i[keep]], b[j[keep]], s[keep]


def neighbours(vectors: DataFrame, key: str, x: str, k: int = 5, least: float = 0.85, spread: float = SPREAD, reach: float = REACH, list_rows: int = LIST_ROWS, block: int = BLOCK) -> DataFrame:
    """(query_no, other_no, similarity, place): the k most similar other vectors of every vector by cosine.

    Only similarities of at least ``least`` count (after rounding to 9 decimals); ties go to the smaller key. Keys are bigint and unique.
    Shorter vectors count as followed by zeros; null, empty and zero vectors and null keys have no neighbours. Of equal vectors only
    the k+1 smallest keys can be neighbours, so further copies are set aside and get the result of their first copy. Within the
    lists read the result is exact; what pruning loses is measured in the tests against brute force.
    """
    spark = vectors.sparkSession
    rows, dim = usable(vectors, key, x)
    rows, spare, _ = set_aside(rows, k + 1)
    sample, n = sample_rows(rows, "id", "x", dim)
    lists = Lists.fit(sample, n, list_rows, block, spread=spread, reach=reach)
    shared = spark.sparkContext.broadcast(vars(lists))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Lists(**shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                ids = part.column("id").to_numpy()
                m = to_matrix(part.column("x"), dim).astype(np.float32)
                posted, asks = index.within(unit(m), spread, reach)
                r, c, own, cell = index.cells(ids, posted | asks)
                columns = [pa.array(v) for v in (c.astype(np.int32), cell.astype(np.int32), own.astype(np.int32), posted[r, c], asks[r, c], ids[r])]
                yield pa.RecordBatch.from_arrays([*columns, pack(m).take(pa.array(r))], ["list", "cell", "block", "posted", "asks", "id", "x"])

    def score(table: pa.Table) -> pa.Table:
        ids, own, posted, asks = (table.column(c).to_numpy() for c in ("id", "block", "posted", "asks"))
        u = unit(unpack(table.column("x"), dim).astype(np.float64))
        rough = u.astype(np.float32)
        first = own == own.min()
        a, b = np.nonzero(first)[0], np.arange(len(ids)) if first.all() else np.nonzero(~first)[0]
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        for at in range(0, len(a), 1000):
            i, j, s = similar(u, rough, a[at : at + 1000], b, least)
            for q, o in ((i, j),) if first.all() else ((i, j), (j, i)):
                some = asks[q] & posted[o] & (ids[q] != ids[o])
                q, o, v = q[some], o[some], s[some]
                top = _best(q, ids[o], v, k)
                for add, x_ in zip(out, (ids[q[top]], ids[o[top]], v[top])):
                    add.append(x_)
        return pa.table(dict(zip(("query_no", "other_no", "similarity"), map(np.concatenate, out))))

    posts = rows.select("id", "x").mapInArrow(post, "list int, cell int, block int, posted boolean, asks boolean, id bigint, x binary")
    posts = posts.repartition(tasks_of(spark, lists.rows, 40 + dim), "list", "cell")
    found = write_shared(posts.groupBy("list", "cell").applyInArrow(score, "query_no bigint, other_no bigint, similarity double"), "found")
    heirs = spare.join(found.withColumnRenamed("query_no", "first"), "first").select(F.col("id").alias("query_no"), "other_no", "similarity")
    found = found.union(heirs).union(spare.select("id", "first", F.lit(1.0)))
    # Each list a query reads gives at most k+1 rows; a pair found in several lists is folded here.
    best = F.array_sort(F.collect_set(F.struct((-F.col("similarity")).alias("s"), F.col("other_no").alias("o"))))
    ranked = found.groupBy("query_no").agg(F.slice(best, 1, k).alias("best"))
    return ranked.select("query_no", F.posexplode("best").alias("p", "b")).select("query_no", F.col("b.o").alias("other_no"), (-F.col("b.s")).alias("similarity"), (F.col("p") + 1).alias("place"))


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """(first_no, second_no): each pair of which one is among the other's neighbours, once."""
    return found.select(F.least("query_no", "other_no").alias("first_no"), F.greatest("query_no", "other_no").alias("second_no")).distinct()

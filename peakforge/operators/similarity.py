"""Distances between spectra, cluster quality and clustering of small cohorts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakforge.functions import kernels
from peakforge.functions.arrays import dot, let, mean

TINY = float(np.finfo(np.float64).tiny)


def _norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null if a norm is (nearly) zero."""
    n = _norm(a) * _norm(b)
    return F.when((_norm(a) >= TINY) & (_norm(b) >= TINY), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, within [0, 2]; 1 for a zero spectrum."""
    return F.coalesce(1 - cosine_similarity(a, b), F.lit(1.0))


def contrast_angle(a: Column, b: Column) -> Column:
    """Angle over the right angle, within [0, 2]; 1 for a zero spectrum."""
    return F.coalesce(F.acos(cosine_similarity(a, b)) * F.lit(2 / np.pi), F.lit(1.0))


def pearson_distance(a: Column, b: Column) -> Column:
    """1 - correlation; 1 where it is undefined."""
    centred = lambda x: let(mean(x), lambda m: F.transform(x, lambda v: v.cast("double") - m))
    return let(F.struct(centred(a).alias("a"), centred(b).alias("b")), lambda s: cosine_distance(s["a"], s["b"]))


METRICS = {"cosine": cosine_distance, "angle": contrast_angle, "pearson": pearson_distance}


def query_distances(queries: DataFrame, others: DataFrame, key: str, x: str, metric: str = "cosine", block: int = 512) -> DataFrame:
    """(i, j, distance) of every row of a stated set of queries to every other row.

    Queries are put into blocks of ``block`` vectors; a task holds one block as a matrix and streams rows past it. The number of
    blocks replicates the rows, so the query set should be small against the table, which makes it a search and no all-pairs join.
    """
    q = queries.select(F.col(key).alias("i"), F.col(x).alias("a")).where("a is not null")
    n = q.count()
    blocks = max(1, -(-n // block))
    numbered = q.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(blocks)))
    held = numbered.groupBy("b").agg(F.collect_list(F.struct("i", "a")).alias("held"))
    rows = others.select(F.col(key).alias("j"), F.col(x).alias("c")).where("c is not null").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("b", F.col("b").cast("bigint"))
    pairs = rows.join(held, "b").select("j", "c", F.explode("held").alias("h")).where("j <> h.i")
    return pairs.select(F.col("h.i").alias("i"), "j", METRICS[metric](F.col("h.a"), F.col("c")).alias("distance"))


def silhouettes(distances: DataFrame, labels: DataFrame) -> DataFrame:
    """(i, label, silhouette) of a long distance table (i, j, distance; both directions) and (i, label); a single member scores 0."""
    j = labels.select(F.col("i").alias("j"), F.col("label").alias("other"))
    d = distances.join(labels, "i").join(j, "j").groupBy("i", "label", "other").agg(F.avg("distance").alias("d"))
    s = d.groupBy("i", "label").agg(F.max(F.when(F.col("label") == F.col("other"), F.col("d"))).alias("a"), F.min(F.when(F.col("label") != F.col("other"), F.col("d"))).alias("b"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return s.select("i", "label", value.alias("silhouette"))


def concordance(labels: DataFrame, a: str, b: str) -> DataFrame:
    """(ari, nmi, n): adjusted Rand index and normalised mutual information (arithmetic mean) of two labelings; nulls are left out."""
    t = labels.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    t = t.withColumn("ra", F.sum("n").over(Window.partitionBy(a))).withColumn("rb", F.sum("n").over(Window.partitionBy(b)))
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    sides = [t.groupBy(k).agg(F.first(r).alias("m")).agg(F.sum(two("m")).alias(f"c{r}"), F.sum(F.col("m") * F.log("m")).alias(f"l{r}")) for k, r in ((a, "ra"), (b, "rb"))]
    cell = t.agg(F.sum("n").alias("n"), F.sum(two("n")).alias("c"), F.sum(F.col("n") * F.log("n")).alias("l"))
    one = F.lit(1).alias("one")
    m = cell.select("*", one).join(sides[0].select("*", one), "one").join(sides[1].select("*", one), "one")
    n, pairs = F.col("n"), F.col("n") * (F.col("n") - 1) / 2
    expected, most = F.coalesce(F.try_divide(F.col("cra") * F.col("crb"), pairs), F.lit(0.0)), (F.col("cra") + F.col("crb")) / 2
    ha, hb = F.log(n) - F.col("lra") / n, F.log(n) - F.col("lrb") / n
    info = F.log(n) + (F.col("l") - F.col("lra") - F.col("lrb")) / n
    ari = F.when(most == expected, 1.0).otherwise((F.col("c") - expected) / (most - expected))
    return m.select(ari.alias("ari"), F.when(ha + hb == 0, 1.0).otherwise(2 * info / (ha + hb)).alias("nmi"), n.cast("bigint").alias("n"))


def wasserstein_to(spectra: DataFrame, mz: np.ndarray, intensity: np.ndarray, key: str = "spectrum_no") -> DataFrame:
    """(key, distance): Wasserstein-1 distance of each (mz, intensity) spectrum to one reference; null for empty spectra."""

    def run(frames):
        for f in frames:
            d = [kernels.wasserstein(np.asarray(m, float), np.asarray(x, float), mz, intensity) if m is not None and len(m) else float("nan") for m, x in zip(f["mz"], f["intensity"])]
            yield pd.DataFrame({key: f[key], "distance": d})

    return spectra.select(key, "mz", "intensity").mapInPandas(run, f"{key} bigint, distance double").withColumn("distance", F.when(~F.isnan("distance"), F.col("distance")))


def dtw_to(spectra: DataFrame, x: str, reference: np.ndarray, key: str = "spectrum_no", radius: int | None = None) -> DataFrame:
    """(key, distance): time warping distance of each binned spectrum to one reference."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({key: f[key], "distance": [kernels.warp_path(np.asarray(v, float), reference, radius)[1] for v in f[x]]})

    return spectra.select(key, x).where(F.col(x).isNotNull()).mapInPandas(run, f"{key} bigint, distance double")


POINT_METRICS = ("wasserstein", "dtw")


def distance_of(metric: str, mz_a: np.ndarray, a: np.ndarray, mz_b: np.ndarray, b: np.ndarray, radius: int | None = None) -> float:
    """Distance of two spectra by name: wasserstein, dtw (intensities), or cosine, angle, pearson (spectra of one axis)."""
    if metric == "wasserstein":
        return kernels.wasserstein(mz_a, a, mz_b, b)
    if metric == "dtw":
        return kernels.warp_path(a, b, radius)[1]
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}; known: {', '.join((*METRICS, *POINT_METRICS))}")
    if len(a) != len(b):
        raise ValueError("spectra differ in length")
    u, v = (x - x.mean() if metric == "pearson" else x for x in (a, b))
    n = np.linalg.norm(u) * np.linalg.norm(v)
    c = float(np.clip(u @ v / n, -1, 1)) if n >= TINY else None
    return 1.0 if c is None else float(np.arccos(c) * 2 / np.pi) if metric == "angle" else 1 - c


def pairwise(spectra: DataFrame, metric: str = "wasserstein", key: str = "spectrum_no", mz: str = "mz", x: str = "intensity", block: int = 64, **options) -> DataFrame:
    """(i, j, distance), i < j: the upper triangle of one cohort's distance matrix, at most MOST_LOCAL spectra; more are an error.

    The cohort is cut into blocks, and any two blocks are one task, so that the triangle is spread evenly and no task holds more than
    two blocks. Spectra with null arrays are left out.
    """
    if metric not in METRICS and metric not in POINT_METRICS:
        raise ValueError(f"unknown metric {metric}; known: {', '.join((*METRICS, *POINT_METRICS))}")
    rows = spectra.select(F.col(key).cast("bigint").alias("id"), F.col(mz).alias("mz"), F.col(x).alias("x")).where("id is not null and mz is not null and x is not null")
    n = rows.limit(MOST_LOCAL + 1).count()
    if n > MOST_LOCAL:
        raise ValueError(f"more than {MOST_LOCAL} members; search a stated set of queries, or cluster on posting lists")
    g = max(1, -(-n // block))
    own = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(g)).cast("int"))
    cells = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(g - 1)))).select("id", "mz", "x", "own", (F.least("own", "o") * g + F.greatest("own", "o")).alias("cell"))

    def triangle(table: pa.Table) -> pa.Table:
        ids, own_ = table.column("id").to_numpy(), table.column("own").to_numpy()
        axes, values = ([np.asarray(v, float) for v in table.column(c).to_pylist()] for c in ("mz", "x"))
        first = own_ == own_.min()
        left, right = np.nonzero(first)[0], np.arange(len(ids)) if first.all() else np.nonzero(~first)[0]
        cell = table.column("cell")[0].as_py()
        diagonal = cell // g == cell % g
        out = []
        if metric in METRICS and (diagonal or not first.all()):
            if len({len(v) for v in values}) > 1:
                raise ValueError("spectra differ in length")
            m = np.stack(values)
            m = m - m.mean(axis=1, keepdims=True) if metric == "pearson" else m
            norm = np.linalg.norm(m, axis=1)
            size = norm[left][:, None] * norm[right][None, :]
            c = np.clip(m[left] @ m[right].T / np.where(size >= TINY, size, 1.0), -1, 1)
            d = np.where(size >= TINY, np.arccos(c) * 2 / np.pi if metric == "angle" else 1 - c, 1.0)
            a, b = np.nonzero(ids[left][:, None] < ids[right][None, :]) if diagonal else (v.ravel() for v in np.indices(d.shape))
            i, j = ids[left][a], ids[right][b]
            return pa.table({"i": np.minimum(i, j), "j": np.maximum(i, j), "distance": d[a, b]})
        if diagonal or not first.all():
            out = [(min(ids[a], ids[b]), max(ids[a], ids[b]), distance_of(metric, axes[a], values[a], axes[b], values[b], **options)) for a in left for b in right if not diagonal or ids[a] < ids[b]]
        return pa.table({"i": pa.array([o[0] for o in out], pa.int64()), "j": pa.array([o[1] for o in out], pa.int64()), "distance": pa.array([o[2] for o in out], pa.float64())})

    return cells.groupBy("cell").applyInArrow(triangle, "i bigint, j bigint, distance double")


def leaf_order(distances: DataFrame, method: str = "average") -> DataFrame:
    """(i, place): order of the rows of a distance heatmap by the leaves of the tree, for one cohort of at most MOST_LOCAL members."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        ids, d = _square(f)
        n, tree = len(ids), kernels.linkage(d, method)
        stack, leaves = [2 * n - 2], []
        while stack:
            v = stack.pop()
            if v < n:
                leaves.append(v)
            else:
                stack.extend([int(tree[v - n][1]), int(tree[v - n][0])])
        return pd.DataFrame({"i": ids[leaves], "place": np.arange(1, n + 1)})

    return distances.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "i bigint, place bigint")


def tree_of(distances: DataFrame, method: str = "average") -> DataFrame:
    """(step, a, b, height, size): the merges of the tree (dendrogram) of one cohort of at most MOST_LOCAL members; new nodes are numbered from n on."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        t = kernels.linkage(_square(f)[1], method)
        return pd.DataFrame({"step": np.arange(1, len(t) + 1), "a": t[:, 0].astype(int), "b": t[:, 1].astype(int), "height": t[:, 2], "size": t[:, 3].astype(int)})

    return distances.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "step bigint, a bigint, b bigint, height double, size bigint")


#: Members of a cohort that one task may hold as a matrix.
MOST_LOCAL = 4000


def _square(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ids = np.unique(np.concatenate([f["i"], f["j"]]))
    if len(ids) > MOST_LOCAL:
        raise ValueError(f"more than {MOST_LOCAL} members")
    d = np.zeros((len(ids), len(ids)))
    a, b = np.searchsorted(ids, f["i"]), np.searchsorted(ids, f["j"])
    d[a, b] = f["distance"]
    d[b, a] = f["distance"]
    return ids, d


def clustered(distances: DataFrame, method: str, **options) -> DataFrame:
    """(i, label) of a long distance table (i, j, distance) by hierarchical, kmedoids or hdbscan clustering of one small cohort.

    The matrix is worked on by one task per cohort and holds at most MOST_LOCAL members; more are an error. Larger tables are for the
    clustering on posting lists.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        ids, d = _square(f)
        if method == "hierarchical":
            labels = kernels.cut_tree(kernels.linkage(d, options.get("linkage", "average")), len(ids), options.get("clusters"), options.get("height"))
        elif method == "kmedoids":
            labels = kernels.medoids(d, options.get("clusters", 3))[1] + 1
        else:
            labels = kernels.density_clusters(d, options.get("min_samples", 5), options.get("min_size", 5), options.get("epsilon", 0.0))
        return pd.DataFrame({"i": ids, "label": labels.astype("int32")})

    if method not in ("hierarchical", "kmedoids", "hdbscan"):
        raise ValueError(f"unknown method {method}")
    return distances.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "i bigint, label int")

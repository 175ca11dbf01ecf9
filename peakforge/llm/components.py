"""Connected components of a graph of any size by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.session import drop_shared, write_shared

MOST_ROUNDS = 60


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge (a, b); the component is its smallest node.

    Nodes are bigint. Edges with a null end and loops are ignored, so a node without a partner isn't in the result.
    Each round is two aggregates and two equality joins on edges alone, written to the shared folder; the number of
    rounds grows with the logarithm of the longest path. A node with very many edges meets only one row of the other
    side of each join, so AQE can split it.
    """
    now = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("a is not null and b is not null and a <> b").distinct()
    now = write_shared(now, "edges")
    mark = _print(now)
    for _ in range(MOST_ROUNDS):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        below = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(below, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        nxt = write_shared(small.select("e.hi", "e.lo").where("hi <> lo").distinct(), "edges")
        new = _print(nxt)
        drop_shared(now)
        now = nxt
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("lo").alias("node")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots.select("node", F.col("node").alias("component")))

"""Train, validation and test splits that keep related records together.

Related rows are stars around the smallest row of their isolate and of their patient; their components are placed as a
whole. Placement is grouped iterative stratification: again and again the label with the fewest rows outstanding is
taken, and its components, large ones first, go one by one to the split that needs most of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakforge.functions.numbers import running_total
from peakforge.llm.components import components
from peakforge.session import write_shared

SHARES = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def isolate_code(id_: Column) -> Column:
    """Two site letters, two digits of the year and the running number without leading zeros; null if ``id_`` has none.

    Case, separators, outer blanks and all that follows the running number (replicate, target position, file ending)
    don't count.
    """
    pattern = "^[^a-z0-9]*([a-z]{2})[^a-z0-9]*([0-9]{2})[^a-z0-9]*([0-9]+)"
    text = F.lower(id_)
    part = [F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]
    return F.when(text.rlike(pattern), F.concat(part[0], part[1], F.lit("-"), F.regexp_replace(part[2], "^0+(?=[0-9])", "")))


def patient_number(case_id: Column) -> Column:
    """P and eight digits, however spaced or cased; anything else is null."""
    bare = F.upper(F.regexp_replace(case_id, r"[\s _\-]+", ""))
    return F.when(bare.rlike("^P[0-9]{8}$"), bare)


def relations(rows: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the rows of one isolate and of one patient, one per row and group.

    ``rows`` has row_no, code, patient (null relates nothing) and ref_no, the species (0: unknown). Rows of one code
    with different species are different isolates; an unknown species agrees with any and so connects them.
    """
    coded = rows.where("code is not null").select("row_no", "code", "ref_no")
    isolates = coded.groupBy("code", "ref_no").agg(F.min("row_no").alias("rep"))
    codes = isolates.groupBy("code").agg(F.min("rep").alias("first"), F.max(F.col("ref_no") == 0).alias("open"))
    heads = isolates.join(codes, "code").select("code", "ref_no", F.when(F.col("open"), F.col("first")).otherwise(F.col("rep")).alias("a"))
    by_isolate = coded.join(heads, ["code", "ref_no"]).select("a", F.col("row_no").alias("b"))
    seen = rows.where("patient is not null").select("row_no", "patient")
    by_patient = seen.join(seen.groupBy("patient").agg(F.min("row_no").alias("a")), "patient").select("a", F.col("row_no").alias("b"))
    return by_isolate.union(by_patient).where("a <> b")


def grouped(rows: DataFrame) -> DataFrame:
    """(row_no, component): every row with the smallest row_no it is related to; a row without relation is its own."""
    found = components(relations(rows))
    alone = rows.select("row_no").join(found, F.col("row_no") == F.col("node"), "left_anti")
    return found.select(F.col("node").alias("row_no"), "component").union(alone.select("row_no", F.col("row_no").alias("component")))


def pairs(members: DataFrame) -> DataFrame:
    """(first_no, second_no): all pairs of rows of one component, as the statement of the problem lists them.

    The result is as large as the components demand; everything else in this module works on stars.
    """
    a = members.select("component", F.col("row_no").alias("first_no"))
    b = members.select("component", F.col("row_no").alias("second_no"))
    return a.join(b, "component").where("first_no < second_no").select("first_no", "second_no")


def _order(sets: list[tuple]) -> dict:
    """Rank of each label: again and again the label with the fewest rows among the components not yet dealt.

    ``sets`` has (labels, {label: rows}) of all components with these labels, once per set.
    """
    left: dict = {}
    holds: dict = {}
    for i, (_, rows) in enumerate(sets):
        for label, n in rows.items():
            left[label] = left.get(label, 0) + n
            holds.setdefault(label, []).append(i)
    rank: dict = {}
    dealt: set = set()
    while len(rank) < len(left):
        label = min((x for x in left if x not in rank), key=lambda x: (left[x], x))
        rank[label] = len(rank)
        for i in holds[label]:
            if i not in dealt:
                dealt.add(i)
                for other, n in sets[i][1].items():
                    left[other] -= n
    return rank


def _deal(need: dict, label: int, vector: dict, m: int, shares) -> list[int]:
    """How many of ``m`` components of the same ``vector`` (rows by label) each split gets; lowers ``need`` by them.

    Each goes to the split that needs most of ``label``, equal needs to the one that needs most rows at all. What all
    splits are sure to get on the way to equal needs is dealt at once, the few others one by one; the result is the same.
    """
    own, size = need[label], need[None]
    c, every = vector[label], sum(vector.values())
    out = [0] * len(shares)

    def give(i, n):
        out[i] += n
        for x, k in vector.items():
            need[x][i] -= n * k
        size[i] -= n * every

    high = sorted(own, reverse=True)
    level = max((sum(high[:k]) - m * c) / k for k in range(1, len(high) + 1))
    for i, n in enumerate([max(0, math.floor((x - level) / c - 1e-6)) for x in own]):
        give(i, n)
    for _ in range(m - sum(out)):
        give(max(range(len(shares)), key=lambda i: (round(own[i], 6), round(size[i], 6), -i)), 1)
    return out


def assign(spark: SparkSession, members: DataFrame, labels: DataFrame, shares=SHARES) -> DataFrame:
    """(row_no, component, split) for all members.

    ``labels`` is (row_no, label) with a bounded set of labels; rows without label count as label 0. Components with the
    same rows of each label are one kind. The driver gets the row counts by set of labels; one task deals the kinds
    in order and holds only what each split still needs of each label. Within a kind components stand in the order of a
    hash. An empty table gives an empty result.
    """
    rows = members.join(labels, "row_no", "left").select("row_no", "component", F.coalesce("label", F.lit(0)).cast("bigint").alias("label"))
    vector = rows.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))
    group = vector.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("v"))
    group = write_shared(group.select("component", F.to_json("v").alias("kind"), "v"), "vectors")
    kinds = write_shared(group.groupBy("kind").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("m")), "kinds")
    sets: dict = {}
    each = kinds.select(F.transform("v", lambda x: x["label"]).alias("labels"), "m", F.explode("v").alias("x"))
    for key, label, n in each.groupBy("labels", "x.label").agg(F.sum(F.col("x.n") * F.col("m")).alias("n")).collect():
        sets.setdefault(tuple(key), {})[label] = n
    rank = _order(sorted(sets.items()))
    total: dict = {None: 0}
    for part in sets.values():
        for label, n in part.items():
            total[label] = total.get(label, 0) + n
            total[None] += n
    ranks = spark.createDataFrame(list(rank.items()), "label bigint, rank int")
    first = kinds.select("kind", "m", "v", F.explode("v").alias("x")).select("kind", "m", "v", "x.label", "x.n").join(ranks, "label")
    first = first.groupBy("kind").agg(F.min_by(F.struct("rank", "label", "n", "m", "v"), "rank").alias("f")).select("kind", "f.*")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = {label: [n * f for _, f in shares] for label, n in total.items()}
        for b in batches:
            out = []
            for r in b.to_pylist():
                at = 0
                for (split, _), n in zip(shares, _deal(need, r["label"], {x["label"]: x["n"] for x in r["v"]}, r["m"], shares)):
                    if n:
                        out.append((r["kind"], at, at + n, split))
                        at += n
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["kind", "lower", "upper", "split"])

    size = F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    ordered = first.repartition(1).sortWithinPartitions("rank", F.desc("n"), F.desc(size), "kind")
    cuts = write_shared(ordered.select("kind", "label", "m", "v").mapInArrow(deal, "kind string, lower bigint, upper bigint, split string"), "cuts")
    numbered = group.select("component", "kind", F.lit(1).alias("one"), F.xxhash64("component").alias("h"))
    numbered = running_total(numbered, "one", F.shiftright("h", 52), ["h", "component"], ["kind"])
    placed = numbered.join(cuts, "kind").where("before >= lower and before < upper").select("component", "split")
    return members.join(placed, "component").select("row_no", "component", "split")

import random

from pyspark.sql import functions as F

from peakforge.llm import splits
from peakforge.llm.components import components


def test_components_match_union_find(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(64)] + [(2000, 2000 + i) for i in range(100)] + [(5, 5), (None, 7), (8, None)] + [(3, 4)] * 3
    parent = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {a: root(a) for a in parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_codes_and_patients(spark):
    ids = {"KV23-00001234_MALDI2": "kv23-1234", " kv 23 1234 (2)": "kv23-1234", "KV23/1234.txt": "kv23-1234", "KV2300001234": "kv23-1234", "kv-23_01234_C6": "kv23-1234", "KV23-0000": "kv23-0", "QC-CTRL": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in ids], "id string")
    assert [r[0] for r in df.select(splits.isolate_code(F.col("id"))).collect()] == list(ids.values())
    cases = {"P00000012": "P00000012", "p 0000-0012 ": "P00000012", "P000": None, "unknown": None, "0": None, None: None, "P000000123": None}
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    assert [r[0] for r in df.select(splits.patient_number(F.col("c"))).collect()] == list(cases.values())


ROWS = [
    (1, "a", None, 1), (2, "a", None, 1), (3, "a", None, 2), (4, "b", None, 1), (5, "b", None, 0), (6, "b", None, 2), (7, None, "P1", 1), (8, "a", "P1", 2), (9, None, None, 1), (10, None, "P2", 0), (11, None, "P2", 3),
]


def test_relations(spark):
    rows = spark.createDataFrame(ROWS, "row_no bigint, code string, patient string, ref_no bigint")
    m = {r["row_no"]: r["component"] for r in splits.grouped(rows).collect()}
    assert m == {1: 1, 2: 1, 3: 3, 8: 3, 7: 3, 4: 4, 5: 4, 6: 4, 9: 9, 10: 10, 11: 10}
    p = sorted(tuple(r) for r in splits.pairs(splits.grouped(rows)).collect())
    assert p == [(1, 2), (3, 7), (3, 8), (4, 5), (4, 6), (5, 6), (7, 8), (10, 11)]


def test_splits_keep_groups_and_shares(spark):
    rnd = random.Random(2)
    rows = [(i, i // 3 if i < 2400 else 100_000, rnd.choice([1, 1, 1, 2, 2, 3])) for i in range(3000)]
    members = spark.createDataFrame([(i, c) for i, c, _ in rows], "row_no bigint, component bigint")
    labels = spark.createDataFrame([(i, label) for i, _, label in rows if i % 10], "row_no bigint, label bigint")
    out = splits.assign(spark, members, labels)
    assert out.count() == 3000 and out.groupBy("component").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    small = splits.assign(spark, members.where("row_no < 2400"), labels)
    n = {r["split"]: r["count"] / 2400 for r in small.groupBy("split").count().collect()}
    assert abs(n["train"] - 0.8) < 0.02 and abs(n["test"] - 0.1) < 0.02
    rare = {r["split"]: r["count"] for r in small.join(labels, "row_no").where("label = 3").groupBy("split").count().collect()}
    assert abs(rare["train"] / sum(rare.values()) - 0.8) < 0.06
    assert splits.assign(spark, members.limit(0), labels).count() == 0


def test_splits_even_out_what_was_placed(spark):
    # Five components of a rare label: by need 50 rows and 30 rows go to train, 10 to validation, 5 and 5 to test.
    sizes = {1: 50, 2: 30, 3: 10, 4: 5, 5: 5}
    rows = [(c, 7) for c, n in sizes.items() for _ in range(n)]
    # The large component of label 8 brings 100 rows of label 9 to train, so fewer of the 200 loose ones may go there.
    rows += [(10, 8)] + [(10, 9)] * 100 + [(1000 + i, 9) for i in range(200)]
    members = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(rows)], "row_no bigint, component bigint")
    labels = spark.createDataFrame([(i, label) for i, (_, label) in enumerate(rows)], "row_no bigint, label bigint")
    n = {(r["label"], r["split"]): r["count"] for r in splits.assign(spark, members, labels).join(labels, "row_no").groupBy("label", "split").count().collect()}
    assert n == {(7, "train"): 80, (7, "validation"): 10, (7, "test"): 10, (8, "train"): 1, (9, "train"): 240, (9, "validation"): 30, (9, "test"): 30}


def test_dealing_at_once_equals_one_by_one():
    rnd = random.Random(3)
    for _ in range(200):
        vector = {1: rnd.randrange(1, 4), 2: rnd.randrange(1, 6)}
        a = {x: [rnd.uniform(-20, 90) for _ in splits.SHARES] for x in (1, 2, None)}
        b = {x: list(v) for x, v in a.items()}
        m = rnd.randrange(1, 60)
        one = [sum(x) for x in zip(*(splits._deal(b, 1, vector, 1, splits.SHARES) for _ in range(m)))]
        assert splits._deal(a, 1, vector, m, splits.SHARES) == one


def test_order_counts_outstanding_rows():
    # Once label 1 is dealt, only two rows of label 3 are outstanding, so it comes before label 2.
    sets = [((1, 3), {1: 4, 3: 50}), ((2,), {2: 30}), ((3,), {3: 2})]
    assert splits._order(sets) == {1: 0, 3: 1, 2: 2}

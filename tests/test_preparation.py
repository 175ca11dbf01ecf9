import re

import pytest
from pyspark.sql import functions as F

from peakforge.functions.numbers import running_total
from peakforge.operators import compaction, rejects
from peakforge.sources.tables import table

D = {"space": " ", "tab": "\t", "comma": ",", "semicolon": ";"}
NUMBER = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")


def judge(raw, delimiter):
    """Reads a line character by character."""
    raw = raw or ""
    if raw.startswith("#"):
        return None
    d = D.get(delimiter, " ")
    if d == " ":
        raw = re.sub(" +", " ", raw.strip(" ")) if '"' not in raw else raw.strip(" ")
    fields, i, bad = [], 0, False
    while True:
        j = i
        while j < len(raw) and raw[j] == " " and d != " ":
            j += 1
        if j < len(raw) and raw[j] == '"':
            k = j + 1
            while k < len(raw):
                if raw[k] == '"':
                    if raw[k + 1 : k + 2] == '"':
                        k += 2
                        continue
                    break
                k += 1
            if k >= len(raw):
                return "quoting"
            e = k + 1
            while e < len(raw) and raw[e] == " " and d != " ":
                e += 1
            if e < len(raw) and raw[e] != d:
                return "quoting"
            fields.append(raw[j + 1 : k].replace('""', '"'))
            i = e
        else:
            e = raw.find(d, i)
            e = len(raw) if e < 0 else e
            if '"' in raw[i:e]:
                return "quoting"
            fields.append(raw[i:e])
            i = e
        if i >= len(raw):
            break
        i += 1
        while d == " " and raw[i : i + 1] == " ":
            i += 1
    if len(fields) != 2:
        return "columns"
    values = []
    for f in fields:
        f = f.strip(" \t\r")
        if delimiter == "semicolon" and f.count(",") == 1 and "." not in f:
            f = f.replace(",", ".")
        if not NUMBER.match(f):
            return "value"
        values.append(float(f))
    if not 1000 <= values[0] <= 30000 or not 0 <= values[1] < float("inf"):
        return "value"
    return ""


def test_rejects_match_brute_force(spark, data):
    lines, files = table(spark, data, "peak_set_raw"), table(spark, data, "raw_input")
    kinds = {r["file_no"]: r["delimiter"] for r in files.select("file_no", "delimiter").collect()}
    rows = lines.collect()
    want = {r["line_no"]: judge(r["raw"], kinds.get(r["file_no"])) for r in rows}
    got = {r["line_no"]: r["reason"] for r in rejects.rejected_lines(lines, files).collect()}
    assert got == {k: v for k, v in want.items() if v}
    loaded = {r["line_no"] for r in rejects.loaded_lines(lines, files).collect()}
    assert loaded == {k for k, v in want.items() if v == ""}


def test_rejects_edge_cases(spark):
    cases = [
        ("1500.0 2.0", "space", ""), ("  1500.0   2.0 ", "space", ""), ("1500,5;2,5", "semicolon", ""), ("1500,5,2,5", "comma", "columns"),
        ('"1500","2"', "comma", ""), ('"15""00","2"', "comma", "value"), ('"1500,2', "comma", "quoting"), ('15"00,2', "comma", "quoting"), ("", "comma", "columns"),
        (None, "comma", "columns"), ("1500\t", "tab", "value"), ("1500", "tab", "columns"), ("999.9\t1", "tab", "value"), ("1000\t0", "tab", ""), ("30000\t1e999", "tab", "value"),
        ("1500 1e3", "space", ""), ("1500 nan", "space", "value"), ("1500 -1", "space", "value"), ("1500 1", None, ""), ("x" * 200_000, "comma", "columns"), ('"' * 100_001, "comma", "quoting"),
        ("1,234;5", "semicolon", "value"), ("1500;2;", "semicolon", "columns"), ("# 1 2", "tab", None), (" #", "tab", "columns"),
    ]
    lines = spark.createDataFrame([(i, i, raw, 7.0, "clash") for i, (raw, _, _) in enumerate(cases)], "line_no bigint, file_no bigint, raw string, mz double, delimiter string")
    files = spark.createDataFrame([(i, d, "x") for i, (_, d, _) in enumerate(cases)] + [(0, "space", "again"), (None, "tab", "")], "file_no bigint, delimiter string, raw string")
    got = {r["line_no"]: r["reason"] for r in rejects.rejected_lines(lines, files).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(cases) if w}
    n = rejects.loaded_lines(lines, files).count()
    assert n == sum(w == "" for _, _, w in cases)
    assert rejects.rejected_lines(lines.limit(0), files.limit(0)).count() == 0


def test_one_notation(spark):
    cases = {
        "file:///data/a/b.txt": "/data/a/b.txt", "file:/data//a/./b.txt": "/data/a/b.txt", "\\data\\a\\b.txt": "/data/a/b.txt", "/data/x/../a/%62.txt": "/data/a/b.txt", "/../a": "/a",
        "/a/b/../../c": "/c", "/A/b+c%2": "/A/b+c%2", "/a+b%20c": "/a+b c", "": "/",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "path string")
    got = {r["path"]: r["p"] for r in df.select("path", compaction.one_notation(F.col("path")).alias("p")).collect()}
    assert got == {**cases, None: None}


def test_merge_plan_keeps_every_file_once(spark):
    rows = [(i, f"/d/{i}.TXT", 1000 + i, 3, "x") for i in range(50)] + [(99, "/d/./3.TXT", None, 3, "x"), (60, "/d/.h.txt", 5, 1, ""), (61, "/d/_h.txt", 5, 1, ""), (62, "/d/big.txt", 4096, 1, ""), (63, "/d/zero.txt", 0, 1, ""), (64, "/d/unknown.txt", None, 1, ""), (None, "/d/n.txt", 5, 1, ""), (65, None, 5, 1, "")]
    listing = spark.createDataFrame(rows, "file_no bigint, path string, size_bytes bigint, n_points int, group_no string")
    plan = compaction.merge_plan(listing, target=10_000).orderBy("file_no").collect()
    assert [r["file_no"] for r in plan] == [*range(50), 64]
    at, groups = 0, []
    for r in plan:
        groups.append(at // 10_000)
        at += r["bytes"]
    assert [r["group_no"] for r in plan] == groups
    assert compaction.merge_plan(listing.limit(0)).count() == 0


def test_write_merged(spark, tmp_path):
    listing = spark.createDataFrame([(1, "/a.txt", 10, 2), (2, "/b.txt", 10, 1)], "file_no bigint, path string, size_bytes bigint, n_points int")
    lines = spark.createDataFrame([(1, 1, 0, "x"), (2, 1, 0, "x"), (3, 1, 1, "y"), (4, 2, 0, "z")], "line_no bigint, file_no bigint, pos int, raw string")
    plan = compaction.merge_plan(listing, target=15)
    compaction.write_merged(lines, plan, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["file_no"], r["pos"], r["raw"]) for r in back.collect()) == [(1, 0, "x"), (1, 1, "y"), (2, 0, "z")]
    r = compaction.reconcile(lines, listing, plan).agg(F.sum("n_lines"), F.sum("n_incomplete")).first()
    assert tuple(r) == (3, 0)


def test_running_total_matches_plain_window(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("v"), (F.col("id") % 3).alias("g"), F.xxhash64("id").alias("h"))
    got = {r["id"]: r["before"] for r in running_total(df, "v", F.shiftright("h", 58), ["h", "id"], ["g"]).collect()}
    rows = sorted(df.collect(), key=lambda r: (r["g"], r["h"], r["id"]))
    total = {}
    for r in rows:
        assert got[r["id"]] == total.get(r["g"], 0)
        total[r["g"]] = total.get(r["g"], 0) + r["v"]


@pytest.mark.parametrize("name", ["hierarchical", "kmedoids", "hdbscan"])
def test_clustering_labels_every_vector(spark, data, name):
    import __spark_entry__ as entry

    ids = {r[0] for r in spark.read.parquet(f"{data}/embeddings.parquet").where("embedding is not null").select("vec_id").collect()}
    got = entry.queries()[name](spark, data).collect()
    assert len(got) == len(ids) and {r["i"] for r in got} == ids


def test_stability_takes_the_baseline_from_the_test(spark):
    import datetime as dt

    from peakforge.operators import drift

    # Bins 3 and 5 tell the classes apart in the baseline, 3 and 6 in the window.
    rows = []
    for late in (0, 1):
        for i in range(24):
            y = i % 2
            for b in range(8):
                told = b in ((3, 6) if late else (3, 5))
                v = float((i * 7 + b * 5) % 24 // 2 + (100 if told and y else 0))
                rows.append((late * 100 + i, dt.datetime(2024, 1 + 2 * late, 1 + i % 5), y, b, v))
    m = spark.createDataFrame(rows, "spectrum_no bigint, ts timestamp_ntz, y int, bin_index int, intensity double")
    got = drift.tested_stability(m, dt.datetime(2024, 2, 1), 30, n_top=2).collect()
    assert [(round(r["stability_score"], 9), r["n_spectra"]) for r in got] == [(round(1 / 3, 9), 24)]

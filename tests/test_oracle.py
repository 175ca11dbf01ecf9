"""Every query with SQL gives the same rows in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry


#: Queries of which a result without rows is right on the smallest tables.
MAY_BE_EMPTY = {"diff_significant"}


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "~" if math.isnan(v) else f"{v:.5g}" if abs(v) > 1e-9 else "0"
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted("|".join(_cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    r = duck.execute(entry.oracle_sql()[name])
    want = _rows([d[0] for d in r.description], r.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in r.description)
    assert got == want


@pytest.mark.parametrize("rule", ["species <> 'Nublavibrio kimianii'", "species = 'Nublavibrio kimianii' AND mic IS NULL"])
def test_feature_matrix_without_rows(spark, data, tmp_path, rule):
    """A table without the species, or without a value of it, is no error: SQL gives no rows."""
    c = duckdb.connect()
    c.execute(f"create view maldiset as select * from '{data}/maldiset.parquet'")
    c.execute(f"create view metadata as select * from '{data}/metadata.parquet' where {rule}")
    for t in ("maldiset", "metadata"):
        c.execute(f"copy {t} to '{tmp_path}/{t}.parquet'")
    df = entry.queries()["feature_matrix"](spark, str(tmp_path))
    r = c.execute(entry.oracle_sql()["feature_matrix"])
    assert sorted(df.columns) == sorted(d[0] for d in r.description)
    assert df.collect() == r.fetchall() == []


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_computes(spark, data, name):
    """All rows are made, not only planned; columns stay as declared."""
    df = entry.queries()[name](spark, data)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns) and all(len(r) == len(df.columns) for r in rows)
    assert rows or name in MAY_BE_EMPTY


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0

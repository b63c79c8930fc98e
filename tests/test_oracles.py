"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else f"{x:.7g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == columns
    want = sorted(tuple(plain(x) for x in r) for r in rel.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert sorted(tuple(plain(x) for x in r) for r in got.select(*columns).collect()) == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())

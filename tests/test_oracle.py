"""Every query with SQL gives what DuckDB gives, at the smallest scale."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import gustflow.queries as registered

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registered.registered()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return "0" if v == 0 else f"{float(v):.9g}"
    return str(v)[:10] if hasattr(v, "isoformat") and str(v).endswith("00:00:00") else str(v)


def table_of(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_duckdb(spark, duck, name):
    found = QUERIES[name](spark, SF)
    wanted = duck.sql(SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert table_of([tuple(r) for r in found.collect()], found.columns) == table_of(wanted.fetchall(), wanted.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    found = QUERIES[name](spark, SF)
    assert found.columns and found.limit(1).count() == 1

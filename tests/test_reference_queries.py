"""Every query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from prismtext.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tables, name):
    got = QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    want = tables.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    rows = sorted(repr(tuple(r[i] for i in places)) for r in want.fetchall())
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() >= 0

"""Every registered query against DuckDB on the same tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

SF_DIRS = [d for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01") if os.path.isdir(d)]
# The corpus queries have tests of their own.
QUERIES = {
    name: query
    for name, query in entry_module.queries().items()
    if name not in entry_module.LLM_QUERIES and name != "pipeline"
}
ORACLES = entry_module.oracle_sql()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module", params=SF_DIRS, ids=os.path.basename)
def tables(request):
    con = duckdb.connect()
    for file in glob.glob(f"{request.param}/*.parquet"):
        name = os.path.basename(file).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{file}')")
    yield request.param, con
    con.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(ORACLES)


def test_entry(spark):
    assert entry_module.entry(spark).count() == 15


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, tables, name):
    sf_dir, con = tables
    found = QUERIES[name](spark, sf_dir)
    wanted = con.execute(ORACLES[name])
    wanted_columns = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(wanted_columns)
    got = rows(found.columns, found.collect())
    expected = rows(wanted_columns, wanted.fetchall())
    assert got and got == expected

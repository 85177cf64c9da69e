"""Every query that has SQL, against DuckDB on the same files."""

import datetime
import os

import duckdb
import pytest

from offerlane.plans.catalogue import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DIR}/{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    want = duck.sql(SQL[name])
    names = sorted(want.columns)
    assert names == sorted(df.columns)
    types = dict(zip(want.columns, map(str, want.types)))
    assert {c: KINDS[types[c]] for c in names} == dict(df.dtypes)
    rows = lambda rs, cols: sorted((tuple(repr(plain(r[cols.index(c)])) for c in names) for r in rs))
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_run(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0

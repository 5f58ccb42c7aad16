"""Every registered query against its reference SQL, on the smallest given data."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry
from clauseloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return "~" if value is None else str(value)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "message" in df.columns


def test_keys_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.oracle_sql()) == set(registry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in row) for row in df.select(*cols).collect())
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    expected = sorted(tuple(plain(row[i]) for i in at) for row in result.fetchall())
    assert got == expected

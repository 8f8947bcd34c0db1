"""Queries against DuckDB on the small driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as library
from lectern.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(DATA):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return connection


def plain(value):
    return None if value is None or value != value else round(value, 8) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name in catalog.ORACLE_SQL:
        found = duck.execute(catalog.ORACLE_SQL[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == columns
        assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)


def test_entry(spark):
    assert library.entry(spark).columns == ["lang", "n"]
    assert set(catalog.QUERIES) <= set(library.queries()) and set(library.oracle_sql()) <= set(library.queries())

"""Every query that has SQL against DuckDB on the smallest tables; every other one must run."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from doseloom import catalogue, queries

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if value != value else f"{value:.6g}"
    return None if value is None else str(value)


@pytest.mark.parametrize("name", sorted({*catalogue.QUERIES, *queries.QUERIES} & set(SQL)))
def test_equals_sql(spark, duck, folder, name):
    got = entry.queries()[name](spark, folder)
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted((tuple(normal(v) for v in row) for row in cursor.fetchall()), key=str)
    assert sorted((tuple(normal(row[c]) for c in columns) for row in got.collect()), key=str) == want


@pytest.mark.parametrize("name", sorted({*catalogue.QUERIES, *queries.QUERIES} - set(SQL)))
def test_runs(spark, folder, name):
    assert entry.queries()[name](spark, folder).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0

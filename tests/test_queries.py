"""Every registered query against its DuckDB SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from conftest import SF
from tokenloom.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) <= set(driver.queries())
    assert set(QUERIES) <= set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = driver.queries()[name](spark, SF)
    expected = duck.sql(driver.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(expected.columns) == columns
    order = [expected.columns.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in expected.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == want


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert {r["source"] for r in rows} == {"A", "B", "C", "D"}
    assert any(r["ran_out"] for r in rows)

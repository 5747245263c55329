"""Every registered query plans and runs; those with SQL agree with it on the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = list(entry.queries())


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    from compare import compare

    said = compare(spark, con, name, sf)
    assert ": ok" in said or "no SQL" in said, said


def test_contract(spark):
    assert entry.entry(spark).columns and set(entry.oracle_sql()) <= set(NAMES)

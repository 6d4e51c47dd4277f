"""Every registered query with reference SQL, on the tables of the correctness check."""

import os

import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, compare

FOLDER = "/root/testdata/sf0.01"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 6


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert compare(got, con.sql(entry.oracle_sql()[name]).df()) == "ok"

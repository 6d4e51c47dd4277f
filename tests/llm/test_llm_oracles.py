"""Every registered training-data query with reference SQL, on the tables of the correctness check."""

import os

import duckdb
import pytest

from driftline.llm.queries import ORACLES, QUERIES
from tools.compare import TABLES, compare

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER).toPandas(), con.sql(ORACLES[name]).df()) == "ok"


def test_every_numbered_operator_is_registered():
    assert {int(name[2:].split("_")[0]) for name in QUERIES if name.startswith("op")} == set(range(1, 14))

"""Every named query against its SQL, on the smallest scale."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import compare
from tablemill.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(os.path.join(FOLDER, "*.parquet")):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, duck, name):
    verdict = compare(spark, duck, FOLDER, name, queries()[name], oracle_sql()[name])
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    assert entry(spark).count() > 0
    assert set(ORACLES) == set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())

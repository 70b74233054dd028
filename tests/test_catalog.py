"""Every query against its SQL twin on the smallest tables; the rest must at least run."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from marketspark.catalog import ORACLE, QUERIES
from tools.check import canon

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE:
        want = con.execute(ORACLE[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got) == canon(want)
    else:
        assert len(got) > 0


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["symbol", "open_time", "atr"]


def test_oracles_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert QUERIES.items() <= entry_point.queries().items()

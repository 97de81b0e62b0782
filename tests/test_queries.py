"""Every query runs and matches its SQL form on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from workload.oracle import SQL
from workload.queries import QUERIES

FOLDER = os.environ.get("TICKLOOM_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
TABLES = ["part", "orders", "lineitem", "events", "embeddings"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    value = float(value)
    return None if math.isnan(value) else value + 0.0


def _rows(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in records), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows(df.collect(), df.columns) == _rows(result.fetchall(), names)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0

"""Every registered query against its DuckDB equivalent, on the smallest of the given data."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from markscale.plans.catalog import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", entry.SMOKE_DIR)
TABLES = ["documents", "labels", "lineitem", "conversations", "benchmark", "embeddings"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


def comparable(rows):
    def plain(value):
        if isinstance(value, float):
            return None if math.isnan(value) else round(value, 5)
        return value

    return sorted((tuple(plain(v) for v in row) for row in rows), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_duckdb(spark, duck, name):
    result = entry.queries()[name](spark, SF_DIR)
    names = sorted(result.columns)
    expected = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    order = [columns.index(c) for c in names]
    assert sorted(columns) == names
    assert comparable(result.select(names).collect()) == comparable([r[i] for i in order] for r in expected.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0

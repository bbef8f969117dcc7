"""Every registered query against its checking SQL on the smallest data folder."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import compare
from proplake.sources.adapters import BASE_TABLES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
MAY_BE_EMPTY = {"newness_filter", "newness_bucket", "search_properties", "properties_since", "lifecycle_history"}


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in BASE_TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    message, fine = compare(spark, con, FOLDER, name, QUERIES[name], ORACLES.get(name))
    assert fine or (name in MAY_BE_EMPTY and message.startswith("ok 0 rows")), message


def test_entry(spark):
    assert entry.entry(spark).count() > 0

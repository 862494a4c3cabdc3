"""Every registered query against its SQL text on the smallest tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, normal

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, db, name):
    frame = queries()[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    ours = sorted(tuple(normal(r[c]) for c in columns) for r in frame.collect())
    if name not in oracle_sql():
        assert ours
        return
    result = db.execute(oracle_sql()[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    theirs = sorted(tuple(normal(r[found.index(c)]) for c in columns) for r in result.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert len(entry(spark).collect()) == 3

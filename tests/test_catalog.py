"""Every registered query against its SQL on DuckDB."""

from collections import Counter

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from iocscan.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "events", "part", "labels", "benchmark", "conversations", "orders", "lineitem", "customer")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    frame = queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    rows = Counter(tuple(r) for r in frame.select(*columns).collect())
    assert rows
    sql = oracle_sql().get(name)
    if sql is not None:
        result = duck.sql(sql)
        order = sorted(range(len(result.columns)), key=lambda i: result.columns[i])
        assert [result.columns[i] for i in order] == columns
        assert rows == Counter(tuple(r[i] for i in order) for r in result.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0

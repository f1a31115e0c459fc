"""Registered queries against their DuckDB forms on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import rows_of
from checks.queries import QUERIES, TABLES

APPROXIMATE = {"vector_index_topk"}  # held to a recall instead
NAMES = sorted(set(QUERIES) - APPROXIMATE)


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return connection


def test_every_query_has_its_sql():
    assert set(QUERIES) - APPROXIMATE <= set(entry.oracle_sql()) <= set(entry.queries())
    assert not APPROXIMATE & set(entry.oracle_sql())


def test_recall_of_approximate_queries(spark, small):
    for name in APPROXIMATE:
        rows = entry.queries()[name](spark, small).collect()
        assert sum(r["recall"] for r in rows) / len(rows) >= 0.9


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, small, name):
    df = entry.queries()[name](spark, small)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, result.fetchall())

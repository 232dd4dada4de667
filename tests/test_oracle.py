"""Every named query with a SQL twin gives the same rows on both engines."""

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry_point
from check_oracle import TABLES, sorted_rows

QUERIES, ORACLE = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, db, name):
    df = QUERIES[name](spark, SF)
    result = db.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(result.columns)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(result.columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_twin(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0

"""Every registered query with SQL for it, against another engine."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def test_every_query_is_registered_with_sql():
    text = {"pipeline", *entry.llm.queries()} if entry.llm else set()
    assert set(entry.queries()) - set(SQL) <= text
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() >= 8


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, connection, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    cursor = connection.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted(repr(tuple(r[i] for i in order)) for r in cursor.fetchall())
    assert found == expected

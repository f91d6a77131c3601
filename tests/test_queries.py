"""Every registered query against its SQL, on whole tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def _normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        tuple("\0" if row[i] is None else str(row[i]) for i in order) for row in rows
    )


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, duck, name):
    found = queries()[name](spark, SF)
    expected = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    assert sorted(found.columns) == sorted(columns)
    types = {d[0]: str(d[1]) for d in expected.description}
    for field in found.schema:
        spark_type = field.dataType.simpleString()
        if spark_type in TYPES:
            assert TYPES[spark_type] == types[field.name], field.name
    rows = [tuple(r) for r in found.collect()]
    assert _normal(rows, found.columns) == _normal(expected.fetchall(), columns)


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0

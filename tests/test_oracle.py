"""Every registered query against DuckDB on the same tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from panewise.plans import all_queries, all_sql
from tests.conftest import DATA

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
}
QUERIES, SQL = all_queries(), all_sql()
MAY_BE_EMPTY = {"agg_global_empty"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_and_types(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    relation = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    expected_types = dict(zip(relation.columns, map(str, relation.types)))
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == expected_types

    got = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    order = [relation.columns.index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in order) for r in relation.fetchall()), key=repr)
    assert got == expected
    assert got or name in MAY_BE_EMPTY


def test_entry(spark):
    assert contract.entry(spark).count() > 0

"""Every query that SQL can express, against DuckDB on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}
QUERIES = entry_points.queries()
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def tables(data_root):
    connection = duckdb.connect()
    folder = f"{data_root}/sf0.01"
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection, folder


def sorted_rows(rows, order):
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, tables, name):
    connection, folder = tables
    df = QUERIES[name](spark, folder)
    got = df.collect()
    cursor = connection.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == types
    columns = sorted(names)
    left = sorted_rows(got, [df.columns.index(c) for c in columns])
    right = sorted_rows(expected, [names.index(c) for c in columns])
    assert left == right


# Columns that are null where there is nothing to point at.
NULLABLE = {"op13_license_scan": {"first_word", "last_word"}}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_fitted_queries_run(spark, tables, name):
    _, folder = tables
    df = QUERIES[name](spark, folder)
    rows = df.collect()
    assert rows
    full = [c for c in df.columns if c not in NULLABLE.get(name, ())]
    assert not any(r[c] is None or r[c] != r[c] for r in rows for c in full)


def test_entry(spark, data_root):
    df = entry_points.entry(spark)
    assert df.columns == ["date", "dau", "wau_trailing", "stickiness"] and df.count() > 0

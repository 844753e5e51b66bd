"""Every registered query of the engine against its SQL in DuckDB."""

import os

import duckdb
import pytest

from sparkquill import catalog


def connect(sf_dir):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        path = f"{sf_dir}/{file}" + "/*.parquet" * os.path.isdir(f"{sf_dir}/{file}")
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(rows):
    return sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = plain(df.select(*columns).collect())
    found = connect(sf_dir).sql(catalog.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert rows == plain(tuple(row[i] for i in at) for row in found.fetchall())


def test_every_query_is_deterministic_in_names():
    assert set(catalog.ORACLE_SQL) == set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

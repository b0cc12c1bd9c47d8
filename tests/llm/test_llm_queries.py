"""Registered queries with SQL against DuckDB."""

import duckdb
import pytest

from rosterline.llm import queries

TABLES = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, TABLES)
    with duckdb.connect() as db:
        for table in ("documents", "conversations"):
            db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{TABLES}/{table}.parquet'")
        asked = db.execute(queries.ORACLES[name])
        columns, want = [d[0] for d in asked.description], asked.fetchall()
    assert sorted(df.columns) == sorted(columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)

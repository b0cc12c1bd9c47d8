"""Every catalogue query against its SQL counterpart on whole tables."""

import math
from decimal import Decimal
from pathlib import Path

import pytest

import __spark_entry__ as contract
from rosterline.plans.catalogue import QUERIES
from rosterline.plans.oracles import ORACLES

duckdb = pytest.importorskip("duckdb")

DATA = Path("/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return str(value)
    if isinstance(value, (int, float, Decimal)):
        return "nan" if math.isnan(value) else repr(float(value))
    return str(value)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["code", "value", "n", "suppressed", "lt"] and not df.isEmpty()


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    df = contract.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
    result = sql.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert mine == sorted(tuple(plain(row[i]) for i in order) for row in result.fetchall())

"""Every registered core query against its SQL on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quayside.plans import core_queries


def plain(value):
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return ("number", round(float(value), 9))
    return ("text", str(value))


def rows_of(columns, rows):
    return sorted(tuple(plain(r[c]) for c in columns) for r in rows)


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(core_queries.SQL))
def test_query_equals_its_sql(spark, data, duck, name):
    found = entry.queries()[name](spark, data)
    want = duck.execute(core_queries.SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(found.columns) == sorted(names)
    columns = sorted(names)
    assert rows_of(columns, [r.asDict() for r in found.collect()]) == rows_of(columns, [dict(zip(names, r)) for r in want.fetchall()])


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(set(core_queries.QUERIES) - set(core_queries.SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert entry.queries()[name](spark, data).count() > 0

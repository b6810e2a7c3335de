"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_module
from conftest import TABLES

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in NAMES:
        connection.sql(f"create view {name} as select * from '{TABLES}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return value if value is None or isinstance(value, (str, bool)) else str(value)


@pytest.mark.parametrize("name", sorted(entry_module.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, TABLES)
    result = duck.sql(entry_module.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(result.columns)
    places = [result.columns.index(column) for column in columns]
    expected = Counter(tuple(plain(row[place]) for place in places) for row in result.fetchall())
    actual = Counter(tuple(plain(row[column]) for column in columns) for row in df.collect())
    assert actual == expected


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0

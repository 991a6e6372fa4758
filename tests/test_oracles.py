"""Every registered query at the smallest scale: equal to its SQL, or at least running with rows."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tools.check_queries import compare, connect

NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.limit(1).count() == 1
    else:
        result = compare(df, con, sql)
        assert result.startswith("ok"), result


def test_entry(spark, sf):
    assert entry.entry(spark).columns


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())

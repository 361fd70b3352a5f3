"""Every registered query beside its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as E
from check_queries import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_its_sql():
    without = set(E.queries()) - set(SQL)
    assert set(SQL) <= set(E.queries())
    assert all(name.startswith("op") or name == "pipeline" for name in without)  # corpus operators that SQL can't express


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns[:2] == ["loc", "time"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    assert compare(E.queries()[name](spark, FOLDER), con, SQL[name]) == ""

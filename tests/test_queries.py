"""Every registered query against its SQL twin, on the smallest data."""

import os

import oracle
import pytest

import __spark_entry__ as entry

SMALL = os.environ.get("FRAMELARK_SMALL", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert oracle.compare(spark, name, QUERIES[name], SQL[name], SMALL) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0

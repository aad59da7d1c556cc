"""The driver contract, and every SQL-checked query against DuckDB."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_oracle_names_are_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["label", "n", "share"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_equals_sql(spark, sf, con, name):
    assert compare(contract.queries()[name](spark, sf), contract.oracle_sql()[name], con) == []


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_gives_rows(spark, sf, name):
    assert contract.queries()[name](spark, sf).count() > 0

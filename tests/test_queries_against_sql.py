from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as contract
from recurra.orders.queries import QUERIES
from recurra.orders.sql import ORACLE
from tests.comparison import assert_same, sql_connection

DATA = Path("/root/testdata")

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    folder = str(DATA / "sf0.01")
    with sql_connection(folder) as con:
        assert_same(contract.queries()[name](spark, folder), con, contract.oracle_sql()[name])


def test_entry(spark):
    assert contract.entry(spark).count() > 0

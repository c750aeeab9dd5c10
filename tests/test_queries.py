"""Every registered query against its SQL, on the smallest scale."""

import os

import pytest

import __spark_entry__ as contract
from oracle import connect, differences

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are absent")


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_contract_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() == 150


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, name):
    df = contract.queries()[name](spark, SMALL)
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert differences(df, con, sql) == []

"""Every registered query against its SQL, on the smallest data."""

import pytest
from compare import compare, connection

import __spark_entry__ as contract
from attestry.plans import catalog

SF_DIR = contract.SMOKE_DIR


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


def test_every_query_has_its_sql():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert not set(catalog.QUERIES) - set(contract.oracle_sql())


def test_flagship(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    ok, message = compare(
        spark, con, name, contract.queries()[name], contract.oracle_sql().get(name), SF_DIR
    )
    assert ok, message

"""Every named query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as driver
from plaintide.plans import catalog
from tests import oracle
from tests.conftest import TABLES

# The training-data operators have tests of their own in tests/llm.
ALL, TWINS = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def con():
    return oracle.connect(TABLES)


def test_every_query_has_a_twin():
    assert set(ALL) == set(TWINS)
    assert set(ALL) <= set(driver.queries()) and set(TWINS) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(ALL))
def test_same_as_sql(spark, con, name):
    assert oracle.compare(ALL[name](spark, TABLES), con, TWINS[name]) == []


def test_entry(spark):
    assert driver.entry(spark).count() > 0

"""Every registered query gives the rows of its oracle."""

import pytest

import __spark_entry__ as entry
from registry.core import ORACLES, QUERIES
from compare import compare, connect
from conftest import SMALL

# At the smallest scale these filters leave nothing on either side.
MAY_BE_EMPTY = {"filter_in", "semi_in"}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem = compare(spark, con, SMALL, entry.queries()[name], entry.oracle_sql()[name])
    assert not problem or (name in MAY_BE_EMPTY and problem.startswith("no rows")), problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0

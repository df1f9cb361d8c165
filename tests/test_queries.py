"""Every registered query against its SQL on the smallest data set."""

import pytest
from check import compare, connect
from tests_support import SF

from slipway.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    _, error = compare(spark, con, SF, name, QUERIES[name], SQL[name])
    assert error is None, error

"""Every registered query of the core against its SQL on the smallest tables; the others run."""

import pytest

import oracle
from rankloom.plans import registered

QUERIES, SQL = registered()


@pytest.fixture(scope="module")
def con():
    return oracle.views(oracle.SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, con, name):
    oracle.compare(spark, QUERIES[name], SQL[name], folder=oracle.SMALL, con=con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, oracle.SMALL).count() >= 0

"""Every panel query that SQL can express agrees with its SQL on the smallest tables."""

import os

import pytest

from oracle import assert_same, connect
from tessera.plans.oracles import ORACLES
from tessera.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, ORACLES[name])


@pytest.mark.parametrize("name", ["neutralize_general", "slope_p_values", "supervised_pca", "fractional_difference", "top_k_drivers"])
def test_other_queries_have_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

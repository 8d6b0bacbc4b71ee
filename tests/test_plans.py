import pytest

from corpusmill import plans
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_matches_sql(spark, duck, name):
    assert compare(plans.QUERIES[name](spark, SF), duck, plans.SQL[name]) >= 0


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, name):
    df = plans.QUERIES[name](spark, SF)
    assert df.columns and df.collect() is not None

"""Every query with a SQL check must give the same whole result, without cross joins."""

import pytest

from compare import connect, differences
from fitgrain.catalog import ORACLES, QUERIES


@pytest.fixture(scope="session")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = df.toArrow()
    assert differences(got, duck.sql(ORACLES[name]).to_arrow_table()) is None


def test_every_check_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)

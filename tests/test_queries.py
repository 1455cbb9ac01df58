"""Every query of the core against its SQL, or at least run, on the smallest tables."""

import os

import pytest

from folioforge.plans import data_queries, reference_queries
from tests.compare import DATA, assert_same

QUERIES = {**data_queries.QUERIES, **reference_queries.QUERIES}
SQL = {**data_queries.SQL, **reference_queries.SQL}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SQL:
        assert_same(spark, QUERIES[name], SQL[name])
    else:
        assert QUERIES[name](spark, DATA).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_filters_reach_the_scan(spark):
    df = reference_queries.filter_exact_version(spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(version,1.2)" in plan or "EqualNullSafe(version,1.2)" in plan
    assert "content" not in plan.split("ReadSchema")[1]


def test_applying_a_plan_computes_vectors(spark):
    plan = reference_queries.QUERIES["sync_apply_vectors"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" in plan and "no stored vector for" in plan

"""Every registered query against its SQL, or that it yields rows where there is none."""

import pytest
from conftest import SF_DIR
from oracle import connect, differences

import __spark_entry__ as entry

QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in CHECKS:
        assert differences(df, con, CHECKS[name]) is None
        assert con.execute(f"select count(*) from ({CHECKS[name]})").fetchone()[0] > 0, "the check holds no rows"
    else:
        assert df.count() > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)

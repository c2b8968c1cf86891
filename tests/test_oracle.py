"""Every registered query against its SQL, and what its plan must not contain."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in FORBIDDEN if word in plan]
    assert compare(df, con, oracle_sql()[name]) == ""


def test_entry(spark):
    assert entry(spark).count() > 0

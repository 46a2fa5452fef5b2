"""Plan-shape guards: what the physical plans must (not) contain."""
import pytest

import __spark_entry__ as E
from gradelens.plans.prepare import prepared_cohort
from gradelens.sources.cohort import cohort

from conftest import SF_SMOKE


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_no_cross_products(spark, name):
    p = plan(E.queries()[name](spark, SF_SMOKE))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_feature_chain_stays_in_the_jvm(spark):
    p = plan(prepared_cohort(spark, SF_SMOKE))
    for marker in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF"):
        assert marker not in p
    assert "WholeStageCodegen" in p or "*(" in p


def test_cohort_scans_are_pruned_and_partial(spark):
    df = cohort(spark, SF_SMOKE)
    text = df._jdf.queryExecution().executedPlan().treeString()
    assert "o_orderkey" not in text and "o_orderdate" not in text and "props" not in text
    assert text.count("partial_sum") >= 2

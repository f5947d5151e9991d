"""The driver contract: names, SQL twins, no forbidden plan shapes."""

import os

import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"


def test_every_twin_has_a_query():
    q, o = contract.queries(), contract.oracle_sql()
    assert o and set(o) <= set(q) and all(callable(f) for f in q.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_entry_runs(spark):
    df = contract.entry(spark)
    assert df.columns == ["series_key", "date", "rolled", "growth"] and df.count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", ["annualised_growth", "observables", "sample_split", "counterfactual_table", "laffer_peak",
                                  "shock_convolution", "density", "rolling_sum_one_series", "param_correlation", "fevd"])
def test_plans_have_no_cross_join(spark, name):
    plan = contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "SinglePartition" not in plan

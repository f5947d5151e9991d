"""Queries over every status and every variable, against their SQL twins."""

import glob
import os
import sys

import numpy as np
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..")


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name, column, values", [
    ("var1_ols", "target", {"gf", "go", "gp"}),
    ("moment_distance", None, None),
    ("wide_to_long", "series", {"done", "still_open", "partial"}),
    ("policy_from_draws", None, None)])
def test_whole_jobs_equal_their_twins(spark, name, column, values):
    import duckdb
    sys.path.insert(0, os.path.join(ROOT, "tools"))
    from check import differ
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = contract.queries()[name](spark, SF).toPandas()
    assert len(got) and not differ(got, con.execute(contract.oracle_sql()[name]).fetchdf())
    if column:
        assert set(got[column]) == values


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_var1_over_three_statuses_is_least_squares(spark):
    from panelspark.registry.shock_queries import _panel
    panel = _panel(spark, SF).toPandas()
    got = contract.queries()["var1_ols_statuses"](spark, SF).toPandas()
    for key, g in got.sort_values("pos").groupby("series_key"):
        x = panel[panel.series_key == key].sort_values("quarter_idx")[["gf", "go", "gp"]].to_numpy(float)
        whole = ~np.isnan(np.hstack([x[:-1], x[1:]])).any(axis=1)
        want = np.linalg.lstsq(x[:-1][whole], x[1:][whole], rcond=None)[0].ravel(order="F")
        assert np.allclose(g["coef"], want, atol=1e-6)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_policy_from_draws_has_every_reported_variable(spark):
    from panelspark.operators.policy import REPORTED
    got = contract.queries()["policy_from_draws_all"](spark, SF).toPandas()
    for _, g in got.groupby("run"):
        assert sorted(g["variable"]) == sorted([*REPORTED, "G_total", "ecv"])

"""Samples, scenarios, ranges and groups given as tables, against the same as lists."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators import labels, policy, series
from panelspark.plans.policy import parameter_rows
from panelspark.registry.base import POINT


def by_text(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def base(spark):
    return parameter_rows(spark, *[{"id": i, **POINT, "tau_c_ss": 0.2 + 0.01 * i} for i in range(9)])


def test_samples(spark):
    rng = random.Random(3)
    day0 = dt.date(1990, 1, 1)
    days = [(i, day0 + dt.timedelta(rng.randrange(0, 12000))) for i in range(300)] + [(300, None), (301, dt.date(2001, 1, 1)), (302, dt.date(2001, 1, 1))]
    df = spark.createDataFrame(days, "sample_no int, date date").repartition(4)
    bounds = [("all", None, None), ("none", dt.date(2001, 1, 1), dt.date(2001, 1, 1)), ("one day", dt.date(2001, 1, 1), dt.date(2001, 1, 2)),
              ("past", None, dt.date(1999, 5, 5)), ("future", dt.date(2015, 2, 2), None), ("outside", dt.date(2500, 1, 1), dt.date(2600, 1, 1)),
              ("turned", dt.date(2010, 1, 1), dt.date(2000, 1, 1))]
    bounds += [(f"s{i}", (a := day0 + dt.timedelta(rng.randrange(0, 12000))), a + dt.timedelta(rng.randrange(1, 4000))) for i in range(60)]
    table = spark.createDataFrame(bounds, "sample string, lo date, hi date")
    assert by_text(series.split_samples(df, table)) == by_text(series.split_samples(df, bounds))
    assert series.split_samples(df, table.limit(0)).count() == 0 and series.split_samples(df.limit(0), table).count() == 0


def as_table(spark, scenarios):
    return spark.createDataFrame(scenarios, "scenario string, overrides map<string,double>")


def test_scenarios(spark, base):
    table = as_table(spark, [(n, {k: float(v) for k, v in o.items()}) for n, o in policy.SCENARIOS])
    assert by_text(policy.scenario_changes(base, ["id"], table)) == by_text(policy.scenario_changes(base, ["id"]))
    got, want = ({r["scenario"]: r.asDict() for r in policy.posterior_functional(base, s).collect()} for s in (table, policy.SCENARIOS))
    assert got.keys() == want.keys() and all(got[s][c] == pytest.approx(want[s][c]) for s in got for c in got[s] if c != "scenario")


def test_a_thousand_scenarios_do_not_lengthen_the_plan(spark, base):
    def plan(n):
        many = spark.range(n).select(F.concat(F.lit("s"), "id").alias("scenario"),
                                     F.create_map(F.lit("p_ss"), F.lit(0.01) + F.col("id") / 1e5).alias("overrides"))
        out = policy.apply_overrides(policy.cross_scenarios(base, many))
        assert out.select("id", "scenario").distinct().count() == out.count() == 9 * n
        return len(out._jdf.queryExecution().optimizedPlan().toString())
    assert abs(plan(1000) - plan(3)) < 200


def test_ranges(spark, base):
    table = spark.createDataFrame([(p, lo, hi) for p, (lo, hi) in policy.RANGES.items()], "instrument string, lo double, hi double")
    listed, tabled = policy.sweep(base, ["id"], n=5), policy.sweep(base, ["id"], table, n=5)
    assert by_text(tabled.select(*listed.columns)) == by_text(listed)
    odd = policy.sweep(base, ["id"], spark.createDataFrame([("alpha", 0.6, 0.7)], "instrument string, lo double, hi double"), n=3)
    assert {(round(r["alpha"], 9), r["base_value"]) for r in odd.collect()} == {(0.6, POINT["alpha"]), (0.65, POINT["alpha"]), (0.7, POINT["alpha"])}


def test_groups(spark):
    draws = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("a", 4.0)], "param string, value double")
    groups = {"g": ["a"], "h": ["c", "zz"]}
    table = spark.createDataFrame([(p, g) for g, ps in groups.items() for p in ps] + [("a", "g")], "param string, `group` string")
    assert by_text(labels.select_params(draws, table)) == by_text(labels.select_params(draws, groups))

"""Steady state, scenarios and welfare against published numbers."""

import math

import pytest
from pyspark.sql import functions as F

from panelspark.operators import policy, steady
from panelspark.plans.policy import parameter_rows, revenue_peaks, rows_from_means
from conftest import rows

POINT = {"alpha": 0.6701, "delta_k": 0.0168, "alpha_u": 0.6375, "phi": 0.9761, "xi": 1.9836, "p_ss": 0.0255}

# Steady state at the posterior means, five decimals.
LEVELS = {"c": 0.31834, "y": 0.68596, "y_m": 0.58297, "y_u": 0.10299, "underground_share": 0.15013, "inv": 0.12551,
          "G_h": 0.10194, "G_c": 0.07141, "G_s": 0.06876, "TE": 0.04779, "n_m": 0.19128, "n_u": 0.01984, "utility": -1.47476}
# Published percentage changes per scenario.
TABLE = {
    "y": (2.937, -3.037, 2.916, -2.648),
    "y_m": (4.509, -4.729, 4.588, -3.019),
    "y_u": (-5.963, 6.54, -6.549, -0.549),
    "underground_share": (-8.646, 9.877, -9.197, 2.156),
    "c": (3.663, -3.683, 3.586, -0.05),
    "inv": (7.176, -6.742, 6.985, -7.309),
    "G_c": (-17.743, 16.375, -17.46, 11.595),
    "G_h": (7.826, -7.856, 7.907, -2.546),
    "G_s": (6.065, -6.3, 6.145, -21.112),
    "TE": (-9.505, 10.554, -10.344, -3.634),
    "G_total": (-0.215, -0.268, -0.075, -3.648),
    "ecv": (-3.848, 4.203, -3.788, 0.201),
}


@pytest.fixture(scope="module")
def point(spark):
    return parameter_rows(spark, {"id": 1, **POINT})


def test_levels(point):
    got = steady.steady_state(point).first().asDict()
    assert got["status"] == "ok"
    for name, want in LEVELS.items():
        assert got[name] == pytest.approx(want, abs=6e-6), name


def test_equilibrium_conditions_hold(point):
    r = steady.steady_state(point).first().asDict()
    spent = r["c"] + r["inv"] + r["G_c"] + r["G_h"] + r["G_s"]
    assert spent == pytest.approx(r["y"], abs=1e-12)
    hours = r["n_m"] + r["n_u"]
    lam = r["c"] ** -r["sigma"]
    assert r["B_0"] * hours ** r["xi"] == pytest.approx((1 - r["tau_h_ss"]) * r["w_m"] * lam, rel=1e-12)
    assert r["B_0"] * hours ** r["xi"] + r["B_1"] * r["n_u"] ** r["phi"] == pytest.approx(r["w_u"] * lam, rel=1e-12)


def test_counterfactual_table_matches_published(point):
    got = rows(policy.counterfactual_table(point, ["id"]), "ord")
    assert [r["variable"] for r in got] == list(TABLE)
    for r in got:
        assert (r["cf1_pct"], r["cf2_pct"], r["cf3_pct"], r["cf4_pct"]) == TABLE[r["variable"]], r["variable"]
    assert got[0]["label"] == "PIB total (y)"


def test_ecv_definition_and_reversal(point):
    both = policy.solve_scenarios(point)
    u0, u1, beta = F.col("base_utility"), F.col("utility"), F.col("beta")
    got = rows(both.select("scenario", policy.ecv(u0, u1, beta).alias("a"), policy.ecv(u1, u0, beta).alias("b")), "scenario")
    for r, want in zip(got, (4.002, -4.034, 3.937, -0.201)):
        assert 100 * r["a"] == pytest.approx(want, abs=6e-4)
        assert r["a"] == pytest.approx(1 / (1 + r["b"]) - 1, rel=1e-12)


def test_failed_rows_keep_their_row(spark):
    df = parameter_rows(
        spark, {"id": 1, **POINT}, {"id": 2, **POINT, "alpha": None}, {"id": 3, **POINT, "tau_h_ss": 1.0},
        {"id": 4, **POINT, "alpha": 0.6, "alpha_u": 0.95}, {"id": 5, **POINT, "phi": 3.0, "xi": 0.5},
        {"id": 6, **POINT, "xi": float("nan")})
    got = rows(steady.steady_state(df), "id")
    assert [r["status"] for r in got][:4] == ["ok", "null_param", "bad_param", "no_interior"]
    assert got[4]["status"] in ("no_interior", "ok") and got[5]["status"] == "null_param"
    for r in got:
        assert (r["y"] is None) == (r["status"] != "ok")


def test_filter_on_outputs_compiles_small(point):
    got = steady.steady_state(point).filter("status = 'ok' and G_c + G_h > 0 and TE is not null and utility < 0")
    assert got.count() == 1


def test_calibrated_b0_gives_target_hours(point):
    b0 = steady.calibrate_b0(point).first()
    assert b0["b0_star"] == pytest.approx(108.73, abs=0.005)
    again = steady.steady_state(point.withColumn("B_0", F.lit(b0["b0_star"]))).first()
    assert again["n_m"] + again["n_u"] == pytest.approx(0.19, abs=1e-10)


def test_size_table(point):
    got = steady.size_table(steady.steady_state(point)).first()
    assert got["share_pct"] == pytest.approx(15.0135, abs=1e-3)
    assert got["hours_share"] == pytest.approx(0.01984 / (0.19128 + 0.01984), abs=1e-4)


def test_overrides_win_and_unknown_names_are_reported(point):
    scen = [("a", {"tau_c_ss": 0.2, "wrong": 1.0}), ("b", {})]
    crossed = policy.cross_scenarios(point, scen)
    got = {r["scenario"]: r["tau_c_ss"] for r in rows(policy.apply_overrides(crossed))}
    assert got == {"a": 0.2, "b": 0.25}
    assert rows(policy.unknown_overrides(crossed)) == [{"name": "wrong", "n": 1}]
    bare = crossed.drop("beta")
    assert policy.apply_overrides(bare, defaults={"beta": 0.99}).first()["beta"] == 0.99


def test_laffer_peaks(point):
    got = {r["instrument"]: r for r in rows(revenue_peaks(point, ["id"], 50))}
    assert got["tau_c_ss"]["peak_value"] == pytest.approx(0.249, abs=1e-3)
    assert got["tau_h_ss"]["peak_value"] == pytest.approx(0.319, abs=1e-3)
    assert got["tau_s_ss"]["peak_value"] == pytest.approx(0.50)
    assert got["tau_c_ss"]["side"] == "above" and got["tau_h_ss"]["side"] == "below"


def test_sweep_keeps_every_grid_point(point):
    swept = policy.sweep(point, ["id"], n=25)
    assert swept.count() == 100
    ends = rows(swept.filter("instrument = 'p_ss'").agg(F.min("grid_value").alias("lo"), F.max("grid_value").alias("hi")))[0]
    assert ends == {"lo": 0.001, "hi": pytest.approx(0.15)}


def test_pct_vs_baseline(spark):
    df = spark.createDataFrame([(1, "base", 2.0), (1, "x", 3.0), (2, "base", 0.0), (2, "x", 1.0), (3, "base", -4.0), (3, "x", -2.0)],
                               "id int, scenario string, value double")
    got = {r["id"]: r["pct"] for r in rows(policy.pct_vs_baseline(df, ["id"], "base"))}
    assert got == {1: 50.0, 2: None, 3: 50.0}


def test_rows_from_means(spark):
    summary = spark.createDataFrame([("r", k, v) for k, v in POINT.items()], "run string, param string, mean double")
    got = steady.steady_state(rows_from_means(summary, list(POINT))).first()
    assert got["run"] == "r" and got["y"] == pytest.approx(LEVELS["y"], abs=6e-6)


def test_posterior_functional(spark):
    df = parameter_rows(spark, *[{"id": i, **POINT, "tau_c_ss": 0.2 + 0.02 * i} for i in range(8)])
    got = {r["scenario"]: r for r in rows(policy.posterior_functional(df))}
    assert got["cf1"]["n"] == 8
    assert 0 < got["cf1"]["self_financing_share"] < 1
    assert math.isfinite(got["cf4"]["ecv_pct_std"]) and got["cf1"]["failed"] == 0


def test_draws_without_a_solution_are_counted(spark):
    df = parameter_rows(spark, {"id": 1, **POINT}, {"id": 2, **POINT}, {"id": 3, **POINT, "phi": None})
    for r in rows(policy.posterior_functional(df)):
        assert (r["n"], r["failed"]) == (2, 1) and r["share_pp_mean"] is not None


def test_open_brackets_and_positive_hours(spark):
    low = {**POINT, "alpha": 0.40, "alpha_u": 0.40, "delta_k": 0.005}
    df = parameter_rows(
        spark, {"id": 1, **low}, {"id": 2, **low, "xi": 4.0, "tau_c_ss": 0.05}, {"id": 3, **POINT, "phi": 2.0, "xi": 1.0},
        {"id": 4, **POINT, "phi": 2.5, "xi": 0.5}, {"id": 5, **POINT, "phi": 1.5, "xi": 1.5})
    got = rows(steady.steady_state(df), "id")
    assert [r["status"] for r in got[:2]] == ["ok", "ok"]
    assert got[0]["c"] == pytest.approx(25.52, abs=0.01) and got[1]["c"] == pytest.approx(64.65, abs=0.01)
    for r in got:
        assert (r["status"] == "ok") == (r["c"] is not None)
        if r["status"] == "ok":
            assert r["n_m"] > 0 and r["n_u"] > 0
            assert r["c"] + r["inv"] + r["G_c"] + r["G_h"] + r["G_s"] == pytest.approx(r["y"])

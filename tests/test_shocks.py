"""Variance shares, contributions, convolution, paths and moments."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import labels, moments, shocks
from conftest import rows


@pytest.fixture(scope="module")
def irf(spark):
    rng = np.random.default_rng(5)
    return spark.createDataFrame(
        [("r", v, s, h, float(rng.normal())) for v in ("y", "c") for s in ("eps_a", "eps_c", "eps_p") for h in range(20)],
        "run string, variable string, shock string, h int, value double")


def test_fevd(irf):
    raw = irf.toPandas()
    got = shocks.fevd(irf, [1, 4, 20], digits=None).toPandas()
    assert np.allclose(got.groupby(["variable", "horizon"])["share"].sum(), 100)
    part = raw[(raw.variable == "y") & (raw.h < 4)]
    sq = (part.value ** 2).groupby(part.shock).sum()
    g = got[(got.variable == "y") & (got.horizon == 4)].set_index("shock")["share"]
    assert np.allclose(g.sort_index(), 100 * (sq / sq.sum()).sort_index())
    long = shocks.fevd(irf, digits=None).toPandas().set_index(["variable", "shock"])["share"].sort_index()
    last = got[got.horizon == 20].set_index(["variable", "shock"])["share"].sort_index()
    assert np.allclose(long, last) and "horizon" not in shocks.fevd(irf).columns


def test_published_variance_table_rows_sum_to_100():
    # Published long-run shares in percent, shocks in the order b a xi_h c h x s p.
    table = {
        "underground_share": (1.69, 10.99, 0.05, 48.2, 10.71, 0.06, 28.29, 0.0),
        "y": (0.01, 27.27, 0.21, 24.69, 8.43, 2.75, 36.64, 0.0),
        "TE": (0.84, 1.97, 0.01, 36.01, 11.6, 0.21, 49.36, 0.0),
    }
    for shares in table.values():
        assert sum(shares) == pytest.approx(100, abs=0.05)


@pytest.fixture(scope="module")
def contrib(spark):
    names = ["eps_a₍ₓ₎", "eps_x₍ₓ₎", "eps_xi_h₍ₓ₎", "eps_c₍ₓ₎", "mean"]
    out = [(r, "y", n, t, (i + 1.0) * (-1) ** (i + t)) for r in ("one", "two") for i, n in enumerate(names) for t in (1, 2)]
    out += [("one", "y", "Initial_values", t, 0.5) for t in (1, 2)]
    df = spark.createDataFrame(out, "run string, variable string, component string, t int, value double")
    clean = F.coalesce(labels.match_shock_name(F.col("component"), labels.SHOCKS), "component")
    return df.withColumn("component", clean)


def test_groups_and_total(contrib):
    g = {(r["run"], r["t"], r["group"]): r for r in rows(shocks.group_contributions(contrib))}
    assert g[("one", 2, "Tecnologia inv.")]["contribution"] == -2.0 and g[("one", 2, "Laboral")]["contribution"] == 3.0
    assert g[("one", 1, "Productivitat")]["rank"] == 0 and g[("one", 1, "Laboral")]["rank"] == 4
    t = {(r["run"], r["t"]): r for r in rows(shocks.component_total(contrib))}
    assert t[("one", 2)]["total"] == 1 - 2 + 3 - 4 + 0.5
    assert t[("two", 2)]["initial"] is None and t[("two", 2)]["total"] == -2.0


def test_convolution(spark, irf):
    rng = np.random.default_rng(9)
    e = {s: rng.normal(size=30) for s in ("eps_a", "eps_c")}
    hits = spark.createDataFrame([("r", s, t, float(v)) for s, x in e.items() for t, v in enumerate(x)],
                                 "run string, shock string, t int, value double")
    got = shocks.shock_convolution(irf, hits, t_max=29).toPandas()
    raw = irf.toPandas().sort_values("h")
    for (v, s), g in got.sort_values("t").groupby(["variable", "shock"]):
        path = raw[(raw.variable == v) & (raw.shock == s)]["value"].to_numpy()
        assert np.allclose(g["value"], np.convolve(e[s], path)[:30])


def test_half_life_and_ar1(spark):
    df = spark.createDataFrame([(0.9463, 0.1), (1.0, 0.1)], "rho double, sigma double")
    got = rows(df.select("rho", shocks.half_life(F.col("rho")).alias("x")), "rho")
    assert got[0]["x"] == pytest.approx(12.56, abs=5e-3) and got[1]["x"] is None
    path = rows(shocks.ar1_irf(df.limit(1), "rho", "sigma", 3), "h")
    assert [r["response"] for r in path] == pytest.approx([0.1 * 0.9463 ** h for h in range(4)])


def test_var1_and_distance(spark):
    rng = np.random.default_rng(2)
    cols = ["y", "c", "i", "n"]
    data, want = [], {}
    for k in ("a", "b"):
        x = rng.normal(size=(60, 4)).cumsum(axis=0) * 0.1
        want[k] = np.linalg.lstsq(x[:-1], x[1:], rcond=None)[0].ravel(order="F")
        data += [(k, t, *map(float, row)) for t, row in enumerate(x)]
    df = spark.createDataFrame(data, "k string, quarter_idx int, y double, c double, i double, n double").repartition(5)
    coef = moments.var1_ols(df, ["k"], cols)
    got = coef.toPandas().sort_values("pos")
    for k, g in got.groupby("k"):
        assert np.allclose(g["coef"], want[k]) and len(g) == 16
    assert list(got[got.k == "a"][["predictor", "target"]].iloc[1]) == ["c", "y"]
    theta = coef.withColumns({"alpha": F.lit(0.3), "beta": F.lit(0.99), "delta": F.lit(0.02), "gamma": F.lit(2.0), "rho": F.lit(0.9)})
    theta = theta.withColumn("out_of_bounds", moments.out_of_bounds())
    d = {r["k"]: r["distance"] for r in rows(moments.moment_distance(theta, coef.filter("k = 'a'"), ["k"]))}
    assert d["a"] == 0 and d["b"] == pytest.approx(((want["b"] - want["a"]) ** 2).sum())
    bad = theta.withColumn("alpha", F.lit(1.2)).withColumn("out_of_bounds", moments.out_of_bounds())
    assert {r["distance"] for r in rows(moments.moment_distance(bad, coef.filter("k = 'a'"), ["k"]))} == {moments.PENALTY}
    assert math.isclose(moments.PENALTY, 1e6)


def test_groups_add_up_with_decorated_and_other_names(spark):
    df = spark.createDataFrame([("r", "y", 1, n, float(v)) for n, v in
                                [("eps_a₍ₓ₎", 1), ("eps_c", 2), ("noise", 4), ("mean", 8)]],
                               "run string, variable string, t int, component string, value double")
    got = {r["group"]: r["contribution"] for r in rows(shocks.group_contributions(df))}
    assert got == {"Productivitat": 1.0, "Fiscal": 2.0, "other": 4.0}
    assert sum(got.values()) == rows(shocks.component_total(df))[0]["shocks"]


def test_missing_moments_cost_the_penalty(spark):
    from panelspark.operators import moments
    target = spark.createDataFrame([(0, 1.0), (1, 2.0)], "pos int, coef double")
    df = spark.createDataFrame([("full", 0, 1.5, False), ("full", 1, 3.0, False), ("half", 0, 1.0, False), ("out", None, None, True)],
                               "id string, pos int, coef double, out_of_bounds boolean")
    got = {r["id"]: r["distance"] for r in rows(moments.moment_distance(df, target, ["id"]))}
    assert got == {"full": 1.25, "half": moments.PENALTY, "out": moments.PENALTY}


def bartlett(x, lags):
    """Covariance of the flattened coefficients by the sum over pairs of dates."""
    past, now = x[:-1], x[1:]
    n, k = past.shape
    coef = np.linalg.lstsq(past, now, rcond=None)[0]
    u = now - past @ coef
    g = np.stack([past[:, i] * u[:, j] for j in range(k) for i in range(k)], axis=1)
    s = sum((1 - abs(a - b) / (lags + 1)) * np.outer(g[a], g[b]) for a in range(n) for b in range(n) if abs(a - b) <= lags)
    bread = np.kron(np.eye(k), np.linalg.inv(past.T @ past))
    return coef.ravel(order="F"), bread @ s @ bread


@pytest.mark.parametrize("lags", [0, 1, 5])
def test_distance_with_the_inverse_long_run_covariance(spark, lags):
    rng = np.random.default_rng(12)
    cols, data, series = ["f", "o", "p"], [], {}
    for k in ("a", "b", "c"):
        x = np.zeros((50, 3))
        for t in range(1, 50):
            x[t] = 0.5 * x[t - 1] + rng.normal(size=3)
        series[k] = x
        data += [(k, t, *map(float, row)) for t, row in enumerate(x)]
    df = spark.createDataFrame(data, "k string, quarter_idx int, f double, o double, p double").repartition(5)
    want = {k: bartlett(x, lags) for k, x in series.items()}
    found = moments.moment_covariance(df, ["k"], cols, lags)
    for k, g in found.toPandas().groupby("k"):
        g = g.sort_values(["pos_a", "pos_b"])
        assert np.allclose(g["cov"], want[k][1].ravel(), rtol=1e-9, atol=1e-12)
    coef = moments.var1_ols(df, ["k"], cols)
    got = {r["k"]: r["distance"] for r in rows(moments.moment_distance(
        coef, coef.filter("k = 'a'"), ["k"], matrix=found.filter("k = 'a'")))}
    for k in series:
        d = want[k][0] - want["a"][0]
        assert got[k] == pytest.approx(d @ np.linalg.inv(want["a"][1]) @ d, rel=1e-7, abs=1e-9)
    identity = spark.createDataFrame([(p, p, 1.0) for p in range(9)], "pos_a int, pos_b int, weight double")
    plain, same = ({r["k"]: r["distance"] for r in rows(moments.moment_distance(coef, coef.filter("k = 'a'"), ["k"], matrix=m))}
                   for m in (None, identity))
    assert all(same[k] == pytest.approx(plain[k], abs=1e-12) for k in series)


def test_matrix_distance_keeps_the_penalty(spark):
    target = spark.createDataFrame([(0, 1.0), (1, 2.0)], "pos int, coef double")
    df = spark.createDataFrame([("full", 0, 1.5, False), ("full", 1, 3.0, False), ("half", 0, 1.0, False), ("out", 0, 1.0, True),
                                ("out", 1, 2.0, True)], "id string, pos int, coef double, out_of_bounds boolean")
    matrix = spark.createDataFrame([(0, 0, 2.0), (0, 1, 0.5), (1, 0, 0.5), (1, 1, 1.0)], "pos_a int, pos_b int, weight double")
    got = {r["id"]: r["distance"] for r in rows(moments.moment_distance(df, target, ["id"], matrix=matrix))}
    assert got == {"full": 2 * 0.25 + 2 * 0.5 * 0.5 + 1.0, "half": moments.PENALTY, "out": moments.PENALTY}


@pytest.mark.parametrize("block", [7, 64, 1 << 12])
def test_convolution_by_blocks(spark, block):
    """Gaps in dates and horizons, repeated rows, nulls, NaN and negative dates against the sum over all pairs."""
    rng = np.random.default_rng(10)
    e = [("r", "a", int(t), float(rng.normal())) for t in rng.choice(np.arange(-50, 400), 120, replace=False)] + [("r", "a", 5, 2.0), ("r", "a", 6, None)]
    e += [("r", "b", 10, float("nan")), ("r", "b", 300, 1.0), ("r", "unused", 1, 1.0)]
    p = [("r", v, s, int(h), float(rng.normal())) for v in ("x", "y") for s in "ab" for h in rng.choice(60, 25, replace=False)] + [("r", "x", "a", 3, 1.5)]
    want = {}
    for _, s, t, v in e:
        for _, var, s2, h, r in p:
            if s == s2 and v is not None and t + h <= 380:
                want[var, s, t + h] = want.get((var, s, t + h), 0.0) + v * r
    got = shocks.shock_convolution(spark.createDataFrame(p, "run string, variable string, shock string, h int, value double"),
                                   spark.createDataFrame(e, "run string, shock string, t int, value double"), t_max=380, block=block)
    assert dict(got.dtypes)["t"] == "int"
    found = {(r["variable"], r["shock"], r["t"]): r["value"] for r in got.collect()}
    assert found.keys() == want.keys()
    assert all(found[k] == pytest.approx(v, abs=1e-9, nan_ok=True) for k, v in want.items())


def test_a_long_convolution_makes_few_rows(spark):
    e = spark.range(10_000).selectExpr("'r' AS run", "'a' AS shock", "CAST(id AS INT) AS t", "1.0D AS value")
    p = spark.range(200).selectExpr("'r' AS run", "'x' AS variable", "'a' AS shock", "CAST(id AS INT) AS h", "1.0D AS value")
    got = {r["t"]: r["value"] for r in shocks.shock_convolution(p, e, t_max=9_999).collect()}
    assert len(got) == 10_000 and got[0] == 1 and got[199] == got[9_999] == pytest.approx(200)


def test_near_collinear_panel_equals_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 1)).cumsum(axis=0) * 0.1 + np.zeros((400, 3))
    x[:, 1] += 1e-5 * rng.normal(size=400)
    x[:, 2] += 1e-4 * rng.normal(size=400)
    df = spark.createDataFrame([("k", t, *map(float, r)) for t, r in enumerate(x)], "k string, quarter_idx int, a double, b double, c double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = moments.var1_ols(df, ["k"], ["a", "b", "c"]).toPandas().sort_values("pos")["coef"].to_numpy()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want = np.linalg.lstsq(x[:-1], x[1:], rcond=None)[0].ravel(order="F")
    assert np.allclose(got, want, rtol=1e-8, atol=1e-8)
    past = x[:-1]
    plain = (np.linalg.pinv(past.T @ past) @ (past.T @ x[1:])).ravel(order="F")
    assert np.abs(plain - want).max() > 10 * np.abs(got - want).max()


def test_historical_decomposition(spark, contrib):
    import datetime as dt

    from panelspark.plans.decomposition import historical_decomposition
    dates = spark.createDataFrame([(1, dt.date(1997, 1, 1)), (2, dt.date(2000, 1, 1)), (3, dt.date(2001, 1, 1))], "t int, date date")
    got = rows(historical_decomposition(contrib, dates))
    at = {(r["run"], r["t"], r["part"]): r for r in got}
    assert len(at) == len(got)
    assert at["one", 2, "initial"]["value"] == 0.5 and ("two", 2, "initial") not in at
    assert at["one", 2, "total"]["value"] == 1 - 2 + 3 - 4 + 0.5 and at["one", 2, "total"]["pos_top"] is None
    assert at["one", 1, "total"]["tick"] == "1997" and at["one", 2, "total"]["tick"] == "2000"
    for run in ("one", "two"):
        for t in (1, 2):
            bars = sorted((r for k, r in at.items() if k[:2] == (run, t) and r["rank"] is not None), key=lambda r: r["rank"])
            up = down = 0.0
            for r in bars:
                v = r["value"]
                assert (r["pos_bottom"], r["pos_top"]) == (up, up + max(v, 0)) and (r["neg_bottom"], r["neg_top"]) == (down, down + min(v, 0))
                up, down = up + max(v, 0), down + min(v, 0)
            assert up + down + (0.5 if run == "one" else 0) == at[run, t, "total"]["value"]

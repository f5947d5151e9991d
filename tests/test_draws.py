"""Draw diagnostics against brute force on small fixtures."""

import math
from collections import Counter
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import priors
from panelspark.operators import draws as d
from panelspark.operators import labels, ranks
from panelspark.plans.posterior import posterior_report
from panelspark.sources import tables as io
from conftest import rows

def chains(kind, n=401, m=3, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(m, n))
    if kind == "shifted":
        x[0] += 3
    if kind == "constant":
        x[:] = 2.5
    if kind == "tied":
        x = np.round(x)
    if kind == "ar":
        for t in range(1, n):
            x[:, t] = 0.9 * x[:, t - 1] + x[:, t] * 0.4
    return x


KINDS = ["mixed", "shifted", "constant", "tied", "ar"]


@pytest.fixture(scope="module")
def draws(spark):
    frames = []
    for k in KINDS:
        x = chains(k)
        for c in range(x.shape[0]):
            frames.append(pd.DataFrame({"run": "r", "param": k, "chain": c + 1, "iter": np.arange(1001, 1001 + x.shape[1]),
                                        "value": x[c]}))
    pdf = pd.concat(frames)
    return spark.createDataFrame(pdf, io.DRAWS).repartition(6)


def halves(x):
    h = x.shape[1] // 2
    return np.concatenate([x[:, :h], x[:, -h:]])


def scores(x):
    r = pd.Series(x.ravel()).rank().to_numpy()
    return np.array([NormalDist().inv_cdf(p) for p in (r - 0.375) / (len(r) + 0.25)]).reshape(x.shape)


def rhat(h):
    n = h.shape[1]
    w, b = h.var(axis=1, ddof=1).mean(), h.mean(axis=1).var(ddof=1)
    return math.sqrt(((n - 1) / n * w + b) / w) if w > 0 else None


def ess(h, max_lag=250):
    m, n = h.shape
    c = h - h.mean(axis=1, keepdims=True)
    w = h.var(axis=1, ddof=1).mean()
    if w == 0:
        return None
    var_plus = (n - 1) / n * w + h.mean(axis=1).var(ddof=1)
    top = min(max_lag, n - 4)
    rho = [1.0] + [1 - (w - (c[:, : n - k] * c[:, k:]).sum(axis=1).mean() / n) / var_plus for k in range(1, top + 2)]
    pair = rho[0] + rho[1]
    total, even, k = pair, rho[0], 2
    while k < top:
        even = rho[k]
        step = rho[k] + rho[k + 1]
        if step <= 0:
            break
        pair = min(pair, step)
        total += pair
        k += 2
    tau = max(0.0, 2 * total + max(0.0, even) - 1)
    return min(1 / tau if tau else math.inf, math.log10(m * n)) * m * n


def test_summary_and_quantiles(draws):
    got = {r["param"]: r for r in rows(d.posterior_summary(draws).join(d.posterior_quantiles(draws), d.KEYS))}
    for k in KINDS:
        x = chains(k).ravel()
        assert got[k]["mean"] == pytest.approx(x.mean(), abs=1e-12)
        assert got[k]["std"] == pytest.approx(x.std(ddof=1), abs=1e-12)
        assert got[k]["q975"] == pytest.approx(np.quantile(x, 0.975), abs=1e-12)


def test_rhat(draws):
    got = {r["param"]: r["rhat"] for r in rows(d.rhat_split(draws))}
    for k in KINDS:
        want = rhat(halves(chains(k)))
        assert got[k] == (pytest.approx(want, rel=1e-9) if want else None), k
    assert got["mixed"] < 1.05 < got["shifted"]


@pytest.mark.parametrize("size", [1 << 21, 100])
def test_rhat_rank(draws, size, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_PER_TASK", size)
    got = {r["param"]: r for r in rows(d.rhat_rank(draws))}
    for k in ("mixed", "shifted", "tied", "ar"):
        h = halves(chains(k))
        assert got[k]["rhat_bulk"] == pytest.approx(rhat(scores(h)), rel=1e-9), k
        assert got[k]["rhat_tail"] == pytest.approx(rhat(scores(np.abs(h - np.median(chains(k))))), rel=1e-9), k


@pytest.mark.parametrize("args", [{}, {"block": 64, "max_lag": 40}, {"block": 50, "first_lags": 4}])
def test_effective_sample_size(draws, args):
    lag = args.get("max_lag", 10 ** 9)
    got = {r["param"]: r for r in rows(d.effective_sample_size(draws, **args))}
    for k in ("mixed", "shifted", "tied", "ar"):
        h = halves(chains(k))
        assert got[k]["ess_bulk"] == pytest.approx(ess(scores(h), lag), rel=1e-7), k
        tails = [ess((h <= np.quantile(chains(k), p)).astype(float), lag) for p in (0.05, 0.95)]
        assert got[k]["ess_tail"] == pytest.approx(min(t for t in tails if t is not None), rel=1e-7), k
    assert got["constant"]["ess_bulk"] is None
    assert got["ar"]["ess_bulk"] < got["mixed"]["ess_bulk"] / 5


def test_slow_chains_need_many_lags(spark):
    """An autoregression of .999 against a direct sum over all lags; a trend never ends."""
    rng = np.random.default_rng(5)
    x = np.zeros((2, 6000))
    for t in range(1, x.shape[1]):
        x[:, t] = 0.999 * x[:, t - 1] + rng.normal(size=2)
    trend = np.tile(np.arange(300.0), (2, 1))
    pdf = pd.concat([pd.DataFrame({"run": "r", "param": p, "chain": c, "iter": np.arange(y.shape[1]), "value": y[c]})
                     for p, y in (("slow", x), ("trend", trend), ("quick", rng.normal(size=(2, 400)))) for c in range(2)])
    df = spark.createDataFrame(pdf, io.DRAWS)
    got = {r["param"]: r for r in rows(d.effective_sample_size(df, block=1000))}
    h = halves(x)
    assert got["slow"]["ess_bulk"] == pytest.approx(ess(scores(h), 10 ** 9), rel=1e-7)
    assert not got["slow"]["lag_limited"] and not got["quick"]["lag_limited"] and got["trend"]["lag_limited"]
    short = {r["param"]: r for r in rows(d.effective_sample_size(df, max_lag=250))}
    assert short["slow"]["lag_limited"] and not short["quick"]["lag_limited"]
    assert short["slow"]["ess_bulk"] > 1.3 * got["slow"]["ess_bulk"]


def test_lagged_products_by_direct_sum(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(237, 3))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["bulk", "low", "high"]).assign(
        run="r", param="p", chain=1, half=0, n_half=237, pos=np.arange(237)))
    for first, last, block in ((0, 8, 50), (8, 64, 20), (0, 237, 40), (200, 500, 300)):
        got = d.autocovariance(df, first, last, block).toPandas()
        assert sorted(got["lag"].unique()) == list(range(first, min(last, 237)))
        for k, name in enumerate(("bulk", "low", "high")):
            c = x[:, k] - x[:, k].mean()
            mine = got[got["signal"] == name].set_index("lag")["acov"]
            assert all(mine[g] == pytest.approx((c[:237 - g] * c[g:]).sum() / 237, abs=1e-12) for g in mine.index)


def test_chains_are_halved_without_numbering(spark, monkeypatch):
    monkeypatch.setattr(d, "_PARTS", 4)
    rng = np.random.default_rng(9)
    shapes = {"even": np.arange(10), "odd": np.arange(11) + 7, "one": np.array([5]), "thin": np.arange(0, 900, 9), "two": np.array([-4, 10 ** 12]),
              "gaps": np.sort(rng.choice(10 ** 6, 301, replace=False)), "late": 10 ** 15 + np.sort(rng.choice(10 ** 4, 50, replace=False))}
    pdf = pd.concat([pd.DataFrame({"run": "r", "param": p, "chain": 1, "iter": i, "value": 1.0}) for p, i in shapes.items()])
    got = d.with_half(spark.createDataFrame(pdf, io.DRAWS)).toPandas().sort_values(["param", "iter"])
    for p, i in shapes.items():
        n, h = len(i), len(i) // 2
        mine = [None if np.isnan(v) else int(v) for v in got[got["param"] == p]["half"]]
        assert mine == [0] * h + [None] * (n % 2) + [1] * h, p


@pytest.mark.parametrize("batch", [10_000, 37])
def test_all_pairs_of_many_parameters_in_one_pass(spark, batch):
    """23 parameters, missing draws, one that does not vary, two runs; draws that lie across Arrow batches."""
    rng = np.random.default_rng(4)
    names, bins, frames, want = [f"p{i}" for i in range(23)], 6, [], {}
    for run, n in (("a", 150), ("b", 40)):
        x = 1e6 + rng.normal(size=(n, 23)) @ rng.normal(size=(23, 23))
        x[:, 5] = 2.5
        x[rng.random(x.shape) < 0.1] = np.nan
        x[:, 7] = np.nan if run == "b" else x[:, 7]
        want[run] = x
        frames += [pd.DataFrame({"run": run, "param": p, "chain": np.arange(n) % 3, "iter": np.arange(n) // 3, "value": x[:, i]})
                   for i, p in enumerate(names)]
    df = spark.createDataFrame(pd.concat(frames).dropna(), io.DRAWS).repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        partials = d.pair_partials(df, names, bins)
        corr = {(r["run"], r["param_a"], r["param_b"]): r["corr"] for r in d.param_correlation(df, names, partials).collect()}
        hist = d.pair_hist2d(df, names, bins, partials).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for run, x in want.items():
        lo, hi = np.nanmin(x, axis=0), np.nanmax(x, axis=0)
        for i in range(23):
            for j in range(i + 1, 23):
                both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
                a, b, found = x[both, i], x[both, j], corr.get((run, names[i], names[j]))
                if 5 in (i, j) or not both.any():
                    assert found is None
                else:
                    assert found == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9)
        for i, j in ((0, 1), (3, 22), (5, 9), (6, 7)):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            cells = [np.minimum(bins - 1, np.floor((x[both, c] - lo[c]) / ((hi[c] - lo[c]) / bins))).astype(int) if hi[c] > lo[c]
                     else np.zeros(both.sum(), int) for c in (i, j)]
            mine = hist[(hist["run"] == run) & (hist["param_a"] == names[i]) & (hist["param_b"] == names[j])]
            got = {(r.bin_a, r.bin_b): r.n for r in mine.itertuples()}
            assert got == dict(Counter(zip(cells[0].tolist(), cells[1].tolist())))


def test_thinned_chains_and_null_draws_count_as_they_are(spark, draws):
    few = draws.filter("param in ('ar', 'tied')")
    gaps = few.withColumn("iter", F.col("iter") * 5 + 3)
    gaps = gaps.union(gaps.filter("iter % 7 = 0").selectExpr("run", "param", "chain", "iter + 1", "cast(null as double)"))
    for measure in (d.effective_sample_size, d.rhat_split):
        want, got = ({tuple(r)[:2]: tuple(r)[2:] for r in measure(x).collect()} for x in (few, gaps))
        assert want.keys() == got.keys() and all(got[k] == pytest.approx(v, rel=1e-9) for k, v in want.items())


def test_report_has_every_parameter(draws):
    got = {r["param"]: r for r in rows(posterior_report(draws, 100.0))}
    assert set(got) == set(KINDS)
    for k in ("mixed", "shifted", "tied", "ar"):
        h = halves(chains(k))
        want = max(rhat(scores(h)), rhat(scores(np.abs(h - np.median(chains(k))))))
        assert got[k]["rhat"] == pytest.approx(want, rel=1e-9), k
    r = got["mixed"]
    assert r["mcse"] == pytest.approx(r["std"] / math.sqrt(r["ess_bulk"]))
    assert r["ess_per_sec"] == pytest.approx(r["ess_bulk"] / 100)


def test_report_takes_seconds_per_run(spark, draws):
    ar = draws.filter("param = 'ar'")
    two = ar.unionByName(ar.selectExpr("'other' AS run", "param", "chain", "iter", "value"))
    two = two.unionByName(ar.selectExpr("'untimed' AS run", "param", "chain", "iter", "value"))
    seconds = spark.createDataFrame([("r", 100.0), ("other", 50.0), ("other", 20.0)], "run string, seconds double")
    got = {r["run"]: r for r in rows(posterior_report(two, seconds))}
    assert set(got) == {"r", "other", "untimed"} and "_seconds" not in got["r"]
    assert got["r"]["ess_per_sec"] == pytest.approx(got["r"]["ess_bulk"] / 100)
    assert got["other"]["ess_per_sec"] == pytest.approx(got["r"]["ess_bulk"] / 50)
    assert got["untimed"]["ess_per_sec"] is None


def test_correlation_and_histogram(draws):
    got = {(r["param_a"], r["param_b"]): r["corr"] for r in rows(d.param_correlation(draws, ["mixed", "tied", "ar"]))}
    a, b = chains("mixed").ravel(), chains("ar").ravel()
    assert got[("mixed", "ar")] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-12)
    hist = d.pair_hist2d(draws, ["mixed", "ar"], bins=7).toPandas()
    want, _, _ = np.histogram2d(a, b, bins=7)
    assert hist["n"].sum() == a.size
    for r in hist.itertuples():
        assert want[r.bin_a, r.bin_b] == r.n


def test_density_integrates_to_one(draws):
    got = d.density(draws.filter("param = 'mixed'"), points=200).toPandas()
    for _, g in got.sort_values("i").groupby("chain"):
        assert np.trapezoid(g["density"], g["x"]) == pytest.approx(1, abs=1e-3)
    exact = chains("mixed")[0]
    bw = 0.9 * min(exact.std(ddof=1), np.subtract(*np.quantile(exact, [0.75, 0.25])) / 1.34) * exact.size ** -0.2
    g = got[got["chain"] == 1].sort_values("i")
    want = np.exp(-0.5 * ((g["x"].to_numpy()[:, None] - exact) / bw) ** 2).sum(axis=1) / (exact.size * bw * math.sqrt(2 * math.pi))
    assert np.allclose(g["density"], want, atol=2e-3)


def test_trace(draws):
    got = rows(d.trace(draws.filter("param = 'mixed' and chain = 2"), width=50), "iter")
    x = chains("mixed")[1]
    assert [r["value"] for r in got] == pytest.approx(list(x))
    assert got[-1]["running_mean"] == pytest.approx(x.mean())
    assert len(rows(d.trace(draws, thin=10))) == len(KINDS) * 3 * 41


def test_comparisons(spark):
    cols = "param string, mean double, q025 double, q975 double"
    a = spark.createDataFrame([("delta_k", 0.0168, 0.0126, 0.0216), ("alpha", 0.6701, 0.653, 0.6882)], cols)
    b = spark.createDataFrame([("delta_k", 0.032, 0.023, 0.043), ("alpha", 0.664, 0.646, 0.682)], cols)
    got = {r["param"]: r for r in rows(d.compare_runs(a, b))}
    assert got["delta_k"]["overlap"] is False and got["alpha"]["overlap"] is True
    assert got["delta_k"]["change_pct"] == pytest.approx(90.476, abs=1e-3)
    truth = spark.createDataFrame([("alpha", 0.63), ("delta_k", 0.015)], "param string, true_value double")
    rec = {r["param"]: r for r in rows(d.recovery_check(a, truth, variances=["delta_k"]))}
    assert rec["alpha"]["covered"] is False and rec["delta_k"]["covered"] is True
    assert rec["delta_k"]["mean"] == pytest.approx(math.sqrt(0.0168))
    pp = {r["param"]: r for r in rows(d.prior_posterior(a, priors.prior_table(spark)))}
    assert pp["alpha"]["prior_mean"] == pytest.approx(0.65, abs=1e-3) and pp["alpha"]["family"] == "Beta"


def test_prior_catalogue(spark):
    table = {r["param"]: r for r in rows(priors.prior_table(spark))}
    assert len(table) == 23 and len(priors.TRUE_VALUES) == 25
    assert table["xi"]["prior_mean"] == pytest.approx(1.0)
    assert table["var_eps_a"]["prior_mean"] == pytest.approx(3.6e-5)
    assert table["rho_c"]["prior_mean"] < 0.9 < 0.97       # truncation lowers the mean


@pytest.mark.parametrize("name", ["alpha", "phi", "gamma_pct", "rho_a", "rho_c", "rho_x", "p_ss", "var_eps_a"])
def test_prior_density_integrates_to_one(spark, name):
    family, a, b, lower, upper = priors.PRIORS_REAL[name]
    lo, hi = {"alpha": (0.55, 0.75), "phi": (0.7, 1.3), "gamma_pct": (0, 1.6), "p_ss": (1e-9, 0.15),
              "var_eps_a": (1e-7, 4e-3)}.get(name, (1e-9, upper))
    x = np.linspace(lo, hi, 40001)
    grid = spark.createDataFrame(pd.DataFrame({"param": name, "x": x}))
    got = priors.prior_pdf(grid).toPandas().sort_values("x")
    assert np.trapezoid(got["pdf"], got["x"]) == pytest.approx(1, abs=2e-3)


def test_flat_priors_and_log_prior(spark):
    table = rows(priors.prior_table(spark, priors.PRIORS_SIMULATED))
    assert len(table) == 25
    df = spark.createDataFrame([("r", "alpha", 1, 1, 0.6), ("r", "rho_a", 1, 1, 0.3), ("r", "alpha", 1, 2, 0.99),
                                ("r", "rho_a", 1, 2, 0.3)], io.DRAWS)
    got = {r["iter"]: r["log_prior"] for r in rows(priors.log_prior(df, priors.PRIORS_SIMULATED))}
    assert got[1] == pytest.approx(-math.log(0.45)) and got[2] is None


def test_perturb_init(spark):
    group = {p: g for g, ps in labels.PARAM_GROUPS.items() for p in ps}
    start = spark.createDataFrame([(p, group[p], v) for p, v in priors.START_VALUES.items()],
                                  "param string, `group` string, start_value double")
    got = {(r["param"], r["chain"]): r["init_value"] for r in rows(priors.perturb_init(start, [(1, 0), (2, 1), (3, -1)]))}
    assert len(got) == 69
    assert got[("alpha", 2)] == pytest.approx(0.65 * 1.001) and got[("alpha", 1)] == 0.65
    assert got[("rho_c", 3)] == pytest.approx(0.899) and got[("var_eps_a", 3)] == pytest.approx(3.6e-5 * 0.999)


def test_draws_io(spark, draws, tmp_path):
    path = str(tmp_path / "draws")
    extra = draws.limit(5).selectExpr("run", "'lp' as param", "chain", "iter", "value")
    io.write_draws(draws.unionByName(extra), path)
    io.write_draws(extra.selectExpr("'other' as run", "'alpha' as param", "chain", "iter", "value"), path)
    assert io.read_draws(spark, path, "r").count() == draws.count()
    assert io.read_draws(spark, path, "r", internals=True).count() == 5
    plan = io.read_draws(spark, path, "other")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in plan

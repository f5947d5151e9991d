"""Posterior draws: summaries, convergence, densities, priors."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from panelspark.functions import numeric, priors
from panelspark.operators import draws as d
from panelspark.operators import labels
from panelspark.plans.posterior import posterior_report
from panelspark.registry.base import draws, register, rounded, sql, table
from panelspark.session import scratch_path
from panelspark.sources import runs
from panelspark.sources import tables as io

SECONDS = 60.0
_GROUPS = {"structural": ["click", "view"], "persistence": ["purchase", "error"]}


# -- SQL building blocks ----------------------------------------------------------------
def _poly_sql(coefs: list, x: str) -> str:
    out = repr(coefs[-1])
    for c in reversed(coefs[:-1]):
        out = f"({out}*{x} + {c!r})"
    return out


def ppf_sql(p: str) -> str:
    """Inverse normal of a column name, same rational approximations as the Column form."""
    r, q = f"(0.180625e0 - ({p}-0.5e0)*({p}-0.5e0))", f"({p}-0.5e0)"
    u = f"sqrt(-ln(least({p}, 1e0-{p})))"
    centre = f"{q}*{_poly_sql(numeric._CENTRE_NUM, r)}/{_poly_sql(numeric._CENTRE_DEN, r)}"
    mid = f"{_poly_sql(numeric._MID_NUM, f'({u}-1.6e0)')}/{_poly_sql(numeric._MID_DEN, f'({u}-1.6e0)')}"
    far = f"{_poly_sql(numeric._FAR_NUM, f'({u}-5e0)')}/{_poly_sql(numeric._FAR_DEN, f'({u}-5e0)')}"
    tail = f"(CASE WHEN {u} <= 5 THEN {mid} ELSE {far} END)"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {centre} WHEN {q} < 0 THEN -{tail} ELSE {tail} END"


_HALVES = ("SELECT run, param, chain, value, n_half, CASE WHEN seq < n_half THEN 0 ELSE 1 END AS half, "
           "CASE WHEN seq < n_half THEN seq ELSE seq - (len - n_half) END AS pos FROM (SELECT *, iter - 1 AS seq, "
           "count(*) OVER (PARTITION BY run, param, chain) AS len, "
           "count(*) OVER (PARTITION BY run, param, chain) // 2 AS n_half FROM dr) WHERE seq < n_half OR seq >= len - n_half")


def _ranked(source: str) -> str:
    return ("SELECT *, (r - 0.375e0)/(n + 0.25e0) AS p FROM (SELECT *, rank() OVER (PARTITION BY run, param ORDER BY value) "
            "+ (count(*) OVER (PARTITION BY run, param, value) - 1)/2e0 AS r, "
            f"count(*) OVER (PARTITION BY run, param) AS n FROM {source})")


def _rhat_sql(source: str, x: str, name: str) -> str:
    return (f"SELECT run, param, sqrt(((avg(n)-1)/avg(n)*avg(v) + var_samp(m))/avg(v)) AS {name} FROM (SELECT run, param, "
            f"chain, half, CAST(count(*) AS DOUBLE) AS n, avg({x}) AS m, var_samp({x}) AS v FROM {source} "
            "GROUP BY 1, 2, 3, 4) GROUP BY 1, 2")


_SUMMARY = ("SELECT run, param, avg(value) AS mean, stddev_samp(value) AS std, count(value) AS n FROM {src} GROUP BY 1, 2")
_QUANT = ("SELECT run, param, " + ", ".join(f"quantile_cont(value, {p}) AS {n}" for n, p in d.QUANTILES.items())
          + " FROM {src} GROUP BY 1, 2")


# -- sources --------------------------------------------------------------------------------
@register("draws_roundtrip", sql(
    "SELECT run, param, chain, row_number() OVER (PARTITION BY run, param, chain ORDER BY event_id) AS iter, value FROM "
    "(SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'first' ELSE 'second' END AS run, event_type AS param, "
    "CAST(user_id % 3 AS INTEGER) AS chain, value FROM events) WHERE run = 'second' AND param <> 'view'"))
def draws_roundtrip(spark, sf):
    path = scratch_path(spark, "draws")
    # one event type plays a sampler column that the reader must leave out
    tagged = draws(spark, sf, runs=True).withColumn("param", F.when(F.col("param") == "view", "lp").otherwise(F.col("param")))
    io.write_draws(tagged, path)
    return io.read_draws(spark, path, run="second")


@register("committed_runs", sql(
    "SELECT run, param, chain, row_number() OVER (PARTITION BY run, param, chain ORDER BY event_id) AS iter, "
    "CASE WHEN run = 'first' THEN 2*value ELSE value END AS value FROM "
    "(SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'first' ELSE 'second' END AS run, event_type AS param, "
    "CAST(user_id % 3 AS INTEGER) AS chain, value FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL)"))
def committed_runs(spark, sf):
    path, found = scratch_path(spark, "runs"), draws(spark, sf, runs=True, stored=True)
    runs.commit_draws(found.withColumn("value", 2 * F.col("value")), path)
    runs.commit_draws(found.filter("run = 'second'"), path)
    runs.stage_draws(found.withColumn("value", -F.col("value")), path)    # never committed
    return runs.read_committed(spark, path)


@register("draws_wide_to_long", sql(
    "SELECT 'all' AS run, param, chain, iter, value FROM (SELECT CAST(p_partkey % 3 AS INTEGER) AS chain, "
    "p_partkey AS iter, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) "
    "UNPIVOT (value FOR param IN (size, price))"))
def draws_wide_to_long(spark, sf):
    wide = table(spark, sf, "part").select(
        F.lit("all").alias("run"), (F.col("p_partkey") % 3).alias("chain"), F.col("p_partkey").alias("iter"),
        F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return io.wide_draws_to_long(wide, ["size", "price"])


# -- summaries --------------------------------------------------------------------------------
@register("posterior_summary", sql(
    "SELECT run, param, round(mean, 6) AS mean, round(std, 6) AS std, n FROM s", "dr", s=_SUMMARY.format(src="dr")))
def posterior_summary(spark, sf):
    return rounded(d.posterior_summary(draws(spark, sf, numbered=False)), 6, "mean", "std")


@register("posterior_quantiles", sql(
    "SELECT run, param, " + ", ".join(f"round({n}, 6) AS {n}" for n in d.QUANTILES) + " FROM q", "dr2",
    q=_QUANT.format(src="dr2")))
def posterior_quantiles(spark, sf):
    return rounded(d.posterior_quantiles(draws(spark, sf, runs=True, numbered=False)), 6, *d.QUANTILES)


@register("param_groups", sql(
    "SELECT CASE WHEN param IN ('click', 'view') THEN 'structural' ELSE 'persistence' END AS \"group\", param, "
    "count(*) AS n, round(avg(value), 6) AS mean FROM dr WHERE param IN ('click', 'view', 'purchase', 'error') GROUP BY 1, 2",
    "dr"))
def param_groups(spark, sf):
    picked = labels.select_params(draws(spark, sf, numbered=False), _GROUPS)
    return picked.groupBy("group", "param").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


# -- convergence ---------------------------------------------------------------------------------
@register("rhat_split", sql("SELECT run, param, round(rhat, 6) AS rhat FROM x", "dr", h=_HALVES,
                            x=_rhat_sql("h", "value", "rhat")))
def rhat_split(spark, sf):
    return rounded(d.rhat_split(draws(spark, sf, stored=True)), 6, "rhat")


_FOLD = ("SELECT run, param, chain, half, abs(value - md) AS value FROM h JOIN "
         "(SELECT run, param, median(value) AS md FROM dr GROUP BY 1, 2) USING (run, param)")


@register("rhat_rank", sql(
    "SELECT run, param, round(rhat_bulk, 6) AS rhat_bulk, round(rhat_tail, 6) AS rhat_tail, "
    "round(greatest(rhat_bulk, rhat_tail), 6) AS rhat FROM b JOIN t USING (run, param)", "dr",
    h=_HALVES, f=_FOLD, hz=f"SELECT *, {ppf_sql('p')} AS z FROM ({_ranked('h')})",
    fz=f"SELECT *, {ppf_sql('p')} AS z FROM ({_ranked('f')})",
    b=_rhat_sql("hz", "z", "rhat_bulk"), t=_rhat_sql("fz", "z", "rhat_tail")))
def rhat_rank(spark, sf):
    return rounded(d.rhat_rank(draws(spark, sf, stored=True)), 6, "rhat_bulk", "rhat_tail", "rhat")


_ESS = {
    "h": _HALVES,
    "hz": f"SELECT *, {ppf_sql('p')} AS z FROM ({_ranked('h')})",
    "ends": "SELECT run, param, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.95) AS q95 FROM dr GROUP BY 1, 2",
    "sig": "SELECT run, param, chain, half, n_half, pos, 'bulk' AS signal, z AS x FROM hz UNION ALL "
           "SELECT run, param, chain, half, n_half, pos, 'low', CAST(value <= q05 AS DOUBLE) FROM h JOIN ends USING (run, param) "
           "UNION ALL SELECT run, param, chain, half, n_half, pos, 'high', CAST(value <= q95 AS DOUBLE) "
           "FROM h JOIN ends USING (run, param)",
    "cen": "SELECT *, avg(x) OVER (PARTITION BY run, param, chain, half, signal) AS m FROM sig",
    "ac": "SELECT a.run, a.param, a.chain, a.half, a.n_half, a.signal, b.pos - a.pos AS lag, max(a.m) AS m, "
          "sum((a.x - a.m)*(b.x - b.m))/max(a.n_half) AS acov FROM cen a JOIN cen b ON a.run = b.run AND a.param = b.param "
          "AND a.chain = b.chain AND a.half = b.half AND a.signal = b.signal "
          "AND b.pos >= a.pos GROUP BY 1, 2, 3, 4, 5, 6, 7",
    "top": "SELECT run, param, signal, var_samp(m) AS b, avg(n_half) AS n, min(n_half) AS nmin, sum(n_half) AS total, "
           "avg(acov*n_half/(n_half-1)) AS w FROM ac WHERE lag = 0 GROUP BY 1, 2, 3",
    "rho": "SELECT run, param, signal, lag // 2 AS pair, lag, total, w, CASE WHEN lag = 0 THEN 1.0 ELSE "
           "1 - (w - acov)/((n-1)/n*w + coalesce(b, 0)) END AS rho FROM (SELECT run, param, signal, lag, avg(acov) AS acov "
           "FROM ac GROUP BY 1, 2, 3, 4) JOIN top USING (run, param, signal) "
           "WHERE (lag // 2)*2 < nmin - 4",
    "pr2": "SELECT run, param, signal, pair, total, w, sum(rho) AS p, sum(rho) FILTER (lag % 2 = 0) AS even "
           "FROM rho GROUP BY 1, 2, 3, 4, 5, 6",
    "mono": "SELECT *, min(CASE WHEN pair = 0 THEN 1.0 ELSE p END) OVER wp > 0 AS alive, min(p) OVER wp AS mono FROM pr2 "
            "WINDOW wp AS (PARTITION BY run, param, signal ORDER BY pair ROWS UNBOUNDED PRECEDING)",
    "tau": "SELECT run, param, signal, total, w, bool_and(alive) AS alive, greatest(0.0, 2*sum(mono) FILTER (alive) + greatest(0.0, "
           "coalesce(min_by(even, pair) FILTER (NOT alive), max_by(even, pair))) - 1) AS tau FROM mono GROUP BY 1, 2, 3, 4, 5",
    "es": "SELECT run, param, signal, coalesce(alive AND w > 0, false) AS limited, CASE WHEN w > 0 THEN CASE WHEN tau = 0 THEN log10(total) ELSE "
          "least(1/tau, log10(total)) END * total END AS ess FROM tau",
    "ess": "SELECT run, param, max(ess) FILTER (signal = 'bulk') AS ess_bulk, min(ess) FILTER (signal <> 'bulk') AS ess_tail, "
           "bool_or(limited) AS lag_limited FROM es GROUP BY 1, 2",
}


@register("effective_sample_size", sql(
    "SELECT run, param, round(ess_bulk, 4) AS ess_bulk, round(ess_tail, 4) AS ess_tail, lag_limited FROM ess", "dr", **_ESS))
def effective_sample_size(spark, sf):
    return rounded(d.effective_sample_size(draws(spark, sf, stored=True)), 4, "ess_bulk", "ess_tail")


@register("posterior_report", sql(
    "SELECT run, param, round(mean, 6) AS mean, round(std, 6) AS std, round(std/sqrt(ess_bulk), 6) AS mcse, "
    "round(ess_bulk, 4) AS ess_bulk, round(ess_tail, 4) AS ess_tail, lag_limited, round(greatest(rhat_bulk, rhat_tail), 6) AS rhat, "
    f"round(ess_bulk/{SECONDS}, 4) AS ess_per_sec, " + ", ".join(f"round({n}, 6) AS {n}" for n in d.QUANTILES)
    + " FROM s JOIN q USING (run, param) JOIN ess USING (run, param) JOIN rb USING (run, param) JOIN rt USING (run, param)",
    "dr", **_ESS, f=_FOLD, fz=f"SELECT *, {ppf_sql('p')} AS z FROM ({_ranked('f')})", rb=_rhat_sql("hz", "z", "rhat_bulk"),
    rt=_rhat_sql("fz", "z", "rhat_tail"), s=_SUMMARY.format(src="dr"), q=_QUANT.format(src="dr")))
def full_report(spark, sf):
    out = posterior_report(draws(spark, sf, stored=True), SECONDS)
    return rounded(rounded(out, 6, "mean", "std", "mcse", "rhat", *d.QUANTILES), 4, "ess_bulk", "ess_tail", "ess_per_sec")


# -- joint and marginal shapes ------------------------------------------------------------------------
_TYPES = ["click", "error", "purchase", "signup", "view"]
_WIDE = ("SELECT run, chain, iter, " + ", ".join(f"max(value) FILTER (param = '{p}') AS {p}" for p in _TYPES)
         + " FROM dr GROUP BY 1, 2, 3")


@register("param_correlation", sql(
    " UNION ALL ".join(f"SELECT run, '{a}' AS param_a, '{b}' AS param_b, round(corr({a}, {b}), 6) AS corr FROM w GROUP BY 1"
                       for a, b in d._pairs(_TYPES)), "dr", w=_WIDE))
def param_correlation(spark, sf):
    return rounded(d.param_correlation(draws(spark, sf), _TYPES), 6, "corr")


def _bin_sql(p: str) -> str:
    return f"CAST(least(9, floor(({p} - {p}_lo)/(({p}_hi - {p}_lo)/10))) AS INTEGER)"


@register("pair_hist2d", sql(
    " UNION ALL ".join(
        f"SELECT run, '{a}' AS param_a, '{b}' AS param_b, {_bin_sql(a)} AS bin_a, {_bin_sql(b)} AS bin_b, count(*) AS n "
        f"FROM w JOIN r USING (run) WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2, 3, 4, 5"
        for a, b in d._pairs(_TYPES)), "dr", w=_WIDE,
    r="SELECT run, " + ", ".join(f"min(value) FILTER (param = '{p}') AS {p}_lo, max(value) FILTER (param = '{p}') AS {p}_hi"
                                 for p in _TYPES) + " FROM dr GROUP BY 1"))
def pair_hist2d(spark, sf):
    return d.pair_hist2d(draws(spark, sf, stored=True), _TYPES, bins=10)


@register("density", sql(
    "SELECT run, param, chain, i, round(lo - 4*bw + i*((hi - lo + 8*bw)/32), 6) AS x, "
    "round(sum(cnt*exp(-0.5*pow(((lo - 4*bw + i*((hi - lo + 8*bw)/32)) - (lo + (cell + 0.5)*((hi - lo)/512)))/bw, 2)))"
    "/(max(n)*max(bw)*2.5066282746310002), 6) AS density FROM c, (SELECT CAST(range AS INTEGER) AS i FROM range(33)) "
    "GROUP BY run, param, chain, i, lo, hi, bw", "dr",
    st="SELECT run, param, chain, min(value) AS lo, max(value) AS hi, CAST(count(*) AS DOUBLE) AS n, "
       "0.9e0*least(stddev_samp(value), (quantile_cont(value, 0.75) - quantile_cont(value, 0.25))/1.34e0)"
       "*pow(count(*), -0.2e0) AS bw FROM dr GROUP BY 1, 2, 3",
    c="SELECT run, param, chain, lo, hi, bw, n, least(511, floor((value - lo)/((hi - lo)/512))) AS cell, count(*) AS cnt "
      "FROM dr JOIN st USING (run, param, chain) GROUP BY 1, 2, 3, 4, 5, 6, 7, 8"))
def density(spark, sf):
    return rounded(d.density(draws(spark, sf, numbered=False), points=33), 6, "x", "density")


@register("trace", sql(
    "SELECT run, param, chain, iter, round(value, 6) AS value, round(running_mean, 6) AS running_mean FROM (SELECT *, avg(value) "
    "OVER (PARTITION BY run, param, chain ORDER BY iter ROWS UNBOUNDED PRECEDING) AS running_mean FROM u) WHERE (iter - 1) % 5 = 0",
    "dr", u="SELECT run, param, chain, iter, value/(value + 20) AS value FROM dr"))
def trace(spark, sf):
    return rounded(d.trace(_unit(draws(spark, sf, stored=True)), thin=5), 6, "value", "running_mean")


# -- comparisons ---------------------------------------------------------------------------------------
def _full_summary(df, keys=d.KEYS):
    return d.posterior_summary(df, keys).join(d.posterior_quantiles(df, keys), keys)


@register("compare_runs", sql(
    "SELECT a.param, round(a.mean, 6) AS mean_a, a.lo AS q025_a, a.hi AS q975_a, round(b.mean, 6) AS mean_b, b.lo AS q025_b, "
    "b.hi AS q975_b, round(100*(b.mean - a.mean)/abs(a.mean), 6) AS change_pct, a.lo <= b.hi AND b.lo <= a.hi AS overlap "
    "FROM s a JOIN s b ON a.param = b.param AND a.run = 'first' AND b.run = 'second'", "dr2",
    s="SELECT run, param, avg(value) AS mean, round(quantile_cont(value, 0.025), 6) AS lo, "
      "round(quantile_cont(value, 0.975), 6) AS hi FROM dr2 GROUP BY 1, 2"))
def compare_runs(spark, sf):
    s = _full_summary(draws(spark, sf, runs=True, numbered=False))
    out = d.compare_runs(s.filter("run = 'first'"), s.filter("run = 'second'"))
    return rounded(out, 6, *[c for c in out.columns if c not in ("param", "overlap")])


_TRUTH = {"click": 20.0, "error": 0.5, "purchase": 17.5, "signup": 900.0}
_TRUTH_ROWS = ", ".join(f"('{k}', {v}e0)" for k, v in _TRUTH.items())


@register("recovery_check", sql(
    "SELECT s.param, round(CASE WHEN s.param = 'click' THEN sqrt(mean) ELSE mean END, 6) AS mean, "
    "round(CASE WHEN s.param = 'click' THEN sqrt(true_value) ELSE true_value END, 6) AS true_value, "
    "round(CASE WHEN s.param = 'click' THEN sqrt(mean) - sqrt(true_value) ELSE mean - true_value END, 6) AS bias, "
    "coalesce(true_value BETWEEN q025 AND q975, FALSE) AS covered FROM s JOIN q USING (run, param) "
    f"LEFT JOIN (VALUES {_TRUTH_ROWS}) t(param, true_value) ON s.param = t.param", "dr", s=_SUMMARY.format(src="dr"),
    q=_QUANT.format(src="dr")))
def recovery_check(spark, sf):
    truth = spark.createDataFrame(list(_TRUTH.items()), "param string, true_value double")
    out = d.recovery_check(_full_summary(draws(spark, sf, numbered=False)), truth, variances=["click"])
    out = out.withColumn("covered", F.coalesce("covered", F.lit(False)))
    return rounded(out.select("param", "mean", "true_value", "bias", "covered"), 6, "mean", "true_value", "bias")


# priors for event values mapped into (0, 1); one per family, two truncated
_PRIORS = {
    "click": ("Beta", 12.0, 3.0, None, 0.97),
    "error": ("Gamma", 25.0, 0.04, None, None),
    "purchase": ("InverseGamma", 3.0, 0.5, None, None),
    "signup": ("Normal", 0.37, 0.20, 0.0, None),
    "view": ("Uniform", 0.10, 0.90, None, None),
}
# the same densities in closed form: a Beta with whole parameters has a binomial tail as its mass
_BETA_MASS = sum(math.comb(14, j) * 0.97 ** j * 0.03 ** (14 - j) for j in range(12, 15))
_NORMAL_MASS = 0.5 * (1 + math.erf(0.37 / 0.20 / math.sqrt(2)))
# a truncated Beta's mean needs the mass of a Beta with one more in its first parameter
_BETA_MEAN = 12 / 15 * sum(math.comb(15, j) * 0.97 ** j * 0.03 ** (15 - j) for j in range(13, 16)) / _BETA_MASS
_NORMAL_MEAN = 0.37 + 0.20 * math.exp(-(0.37 / 0.20) ** 2 / 2) / math.sqrt(2 * math.pi) / _NORMAL_MASS
_LOG_PDF = (
    "CASE WHEN x <= 0 AND param IN ('click', 'error', 'purchase') THEN NULL ELSE CASE param "
    f"WHEN 'click' THEN CASE WHEN x <= 0.97 THEN 11*ln(x) + 2*ln(1-x) + ln({math.factorial(14) / math.factorial(11) / 2}) - ln({_BETA_MASS!r}) END "
    "WHEN 'error' THEN 24*ln(x) - x/0.04 - lgamma(25) - 25*ln(0.04) "
    "WHEN 'purchase' THEN 3*ln(0.5) - ln(2) - 4*ln(x) - 0.5/x "
    f"WHEN 'signup' THEN -0.5*pow((x-0.37)/0.20, 2) - ln(0.20*{math.sqrt(2 * math.pi)!r}*{_NORMAL_MASS!r}) "
    "WHEN 'view' THEN CASE WHEN x BETWEEN 0.1 AND 0.9 THEN -ln(0.8) END END END")


def _unit(df):
    return df.withColumn("value", F.col("value") / (F.col("value") + 20))


@register("prior_pdf", sql(
    f"SELECT param, chain, round(sum(pdf), 4) AS pdf_sum, round(max(pdf), 6) AS pdf_max, count(*) AS n FROM "
    f"(SELECT param, chain, coalesce(exp({_LOG_PDF}), 0) AS pdf FROM (SELECT *, value/(value + 20) AS x FROM dr)) GROUP BY 1, 2", "dr"))
def prior_pdf(spark, sf):
    grid = _unit(draws(spark, sf, numbered=False)).select("param", "chain", F.col("value").alias("x"))
    return priors.prior_pdf(grid, _PRIORS).groupBy("param", "chain").agg(
        F.round(F.sum("pdf"), 4).alias("pdf_sum"), F.round(F.max("pdf"), 6).alias("pdf_max"), F.count(F.lit(1)).alias("n"))


@register("log_prior", sql(
    f"SELECT run, chain, iter, CASE WHEN count(lp) = count(*) THEN round(sum(lp), 4) END AS log_prior FROM "
    f"(SELECT run, chain, iter, {_LOG_PDF} AS lp FROM (SELECT *, value/(value + 20) AS x FROM dr)) GROUP BY 1, 2, 3", "dr"))
def log_prior(spark, sf):
    return rounded(priors.log_prior(_unit(draws(spark, sf)), _PRIORS), 4, "log_prior")


@register("prior_posterior", sql(
    "SELECT param, family, round(mean, 6) AS mean, round(std, 6) AS std, round((mean - pm)/abs(pm), 4) AS shift FROM s JOIN "
    f"(VALUES ('click', 'Beta', {_BETA_MEAN!r}::DOUBLE), ('error', 'Gamma', 1.0e0), ('purchase', 'InverseGamma', 0.25e0), "
    f"('signup', 'Normal', {_NORMAL_MEAN!r}::DOUBLE), ('view', 'Uniform', 0.5e0)) "
    "t(param, family, pm) USING (param)", "dr",
    u="SELECT run, param, value/(value + 20) AS value FROM dr", s=_SUMMARY.format(src="u")))
def prior_posterior(spark, sf):
    summary = d.posterior_summary(_unit(draws(spark, sf, numbered=False)))
    out = d.prior_posterior(summary, priors.prior_table(spark, _PRIORS))
    return rounded(rounded(out.select("param", "family", "mean", "std", "shift"), 6, "mean", "std"), 4, "shift")


@register("perturb_init", sql(
    "SELECT draw_id, \"group\", chain, round(CASE WHEN \"group\" = 'persistence' THEN CASE WHEN sg = 0 THEN v ELSE "
    "least(greatest(v + sg*0.001, 0.05), 0.96) END ELSE v*(1 + sg*0.001) END, 9) AS init_value FROM (SELECT p_partkey AS draw_id, "
    "CASE p_size % 3 WHEN 0 THEN 'structural' WHEN 1 THEN 'persistence' ELSE 'variance' END AS \"group\", p_size/50.0e0 AS v "
    "FROM part), (VALUES (1, 0.0), (2, 1.0), (3, -1.0)) t(chain, sg)"))
def perturb_init(spark, sf):
    group = F.when(F.col("p_size") % 3 == 0, "structural").when(F.col("p_size") % 3 == 1, "persistence").otherwise("variance")
    start = table(spark, sf, "part").select(F.col("p_partkey").alias("draw_id"), group.alias("group"),
                                            (F.col("p_size") / 50.0).alias("start_value"))
    out = priors.perturb_init(start, [(1, 0), (2, 1), (3, -1)])
    return rounded(out.select("draw_id", "group", "chain", "init_value"), 9, "init_value")

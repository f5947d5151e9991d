"""Steady states, scenarios, sweeps and welfare over part rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import policy
from panelspark.operators.draws import posterior_summary
from panelspark.operators.labels import lookup
from panelspark.operators.steady import CALIBRATED, EXTRA, VARIABLES, calibrate_b0, size_table, steady_state, total_revenue
from panelspark.plans.policy import rows_from_means
from panelspark.registry.base import draws, params, register, rounded, sql, table
from panelspark.session import spread

_STEPS = 58    # halvings of an interval of at most 120


def _tech(source: str) -> str:
    """Ratios of the steady state; later aliases use earlier ones."""
    return ("SELECT *, gamma_ss/beta - 1 + delta_k AS ru, ru/(1 - tau_h_ss) AS rm, rm/((1 - tau_c_ss)*(1 - alpha)) AS ykm, "
            "ru/((1 - p_ss*s*tau_c_ss)*(1 - alpha_u)) AS yku, pow(ykm, 1/alpha)/gamma_ss AS hkm, "
            "pow(yku, 1/alpha_u)/gamma_ss AS hku, ykm/hkm AS ym, yku/hku AS yu, "
            "alpha*ym*(1 - tau_c_ss)/(1 + tau_s_ss - tau_c_ss) AS wm, alpha_u*yu AS wu, (1 - tau_h_ss)*wm AS net, "
            "wu - net AS gap, (gamma_ss - 1 + delta_k)/hkm AS im, (gamma_ss - 1 + delta_k)/hku AS iu, "
            "im + tau_h_ss*(wm + rm/hkm) + tau_c_ss*(ym - wm) + tau_s_ss*wm - ym AS kapm, "
            f"iu + tau_c_ss*p_ss*s*(yu - wu) - yu AS kapu FROM ({source})")


def _bisect(source: str) -> str:
    """Halve (l0, h0) until it is a point; the equation in log consumption has coefficients a1 k1 a2 k2."""
    out = f"SELECT *, CAST(0 AS DOUBLE) AS f0 FROM ({source})"
    for i in range(1, _STEPS + 1):
        low, high = f"l{i - 1}", f"h{i - 1}"
        mid = f"(({low} + {high})/2)"
        out = (f"SELECT * EXCLUDE ({low}, {high}, f{i - 1}), exp({mid}) + a1*exp(-k1*{mid}) + a2*exp(-k2*{mid}) AS f{i}, "
               f"CASE WHEN f{i} < 0 THEN {mid} ELSE {low} END AS l{i}, CASE WHEN f{i} < 0 THEN {high} ELSE {mid} END AS h{i} "
               f"FROM ({out})")
    return f"SELECT *, (l{_STEPS} + h{_STEPS})/2 AS x FROM ({out})"


def steady_sql(source: str) -> str:
    """All steady-state variables for the parameter rows of ``source``; rows without a bracket drop out."""
    coef = ("SELECT *, pow(gap/B_1, 1/phi) AS hu, pow(net/B_0, 1/xi) AS hm, sigma/xi AS k1, sigma/phi AS k2, "
            "kapm*hm AS a1, (kapu - kapm)*hu AS a2, (ln(hu) - ln(hm))/(k2 - k1) AS edge, CASE WHEN k2 > k1 THEN edge ELSE -60e0 END AS l0, "
            "CASE WHEN k2 > k1 THEN 60e0 ELSE edge END AS h0 "
            f"FROM ({_tech(source)}) WHERE gap > 0 AND k1 <> k2")
    return ("SELECT *, exp(x) AS c, hu*pow(c, -k2) AS n_u, hm*pow(c, -k1) - n_u AS n_m, ym*n_m AS y_m, yu*n_u AS y_u, "
            "y_m + y_u AS y, y_u/y AS underground_share, im*n_m + iu*n_u AS inv, "
            "tau_c_ss*(p_ss*s*(y_u - wu*n_u) + y_m - wm*n_m) AS G_c, tau_h_ss*(wm*n_m + rm/hkm*n_m) AS G_h, "
            "tau_s_ss*wm*n_m AS G_s, tau_s_ss*wu*n_u + tau_h_ss*(wu*n_u + ru/hku*n_u) + (1 - p_ss)*tau_c_ss*(y_u - wu*n_u) AS TE, "
            "wm AS w_m, wu AS w_u, ln(c) - B_0*pow(n_m + n_u, 1 + xi)/(1 + xi) - B_1*pow(n_u, 1 + phi)/(1 + phi) AS utility "
            f"FROM ({_bisect(coef)})")


_PR = "SELECT * FROM pr"
_ALL = VARIABLES + EXTRA


@register("steady_state", sql(
    "SELECT draw_id, 'ok' AS status, " + ", ".join(f"round({c}, 6) AS {c}" for c in _ALL) + f" FROM ({steady_sql(_PR)})", "pr"))
def steady(spark, sf):
    return rounded(steady_state(params(spark, sf)).select("draw_id", "status", *_ALL), 6, *_ALL)


@register("steady_state_status", sql(
    "SELECT status, count(*) AS n FROM (SELECT CASE draw_id % 4 WHEN 0 THEN 'null_param' WHEN 1 THEN 'bad_param' "
    "WHEN 2 THEN 'no_interior' ELSE 'ok' END AS status FROM pr) GROUP BY 1", "pr"))
def steady_status(spark, sf):
    broken = params(spark, sf).withColumns({
        "xi": F.when(F.col("draw_id") % 4 != 0, F.col("xi")),
        "tau_h_ss": F.when(F.col("draw_id") % 4 == 1, 1.0).otherwise(F.col("tau_h_ss")),
        "alpha": F.when(F.col("draw_id") % 4 == 2, 0.60).otherwise(F.col("alpha")),
        "alpha_u": F.when(F.col("draw_id") % 4 == 2, 0.95).otherwise(F.col("alpha_u"))})
    return steady_state(broken).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# phi above, at and below xi, and capital shares under which consumption exceeds 10: an interior row has
# positive hours in both sectors and its resources add up
_REGIONS = ("SELECT * REPLACE (CASE draw_id % 4 WHEN 0 THEN 2.0e0 WHEN 1 THEN 2.5e0 ELSE phi END AS phi, "
            "CASE draw_id % 4 WHEN 0 THEN 1.0e0 WHEN 1 THEN 0.5e0 WHEN 3 THEN 4.0e0 ELSE xi END AS xi, "
            "CASE WHEN draw_id % 4 >= 2 THEN 0.40e0 ELSE alpha END AS alpha, CASE WHEN draw_id % 4 >= 2 THEN 0.40e0 ELSE alpha_u END "
            "AS alpha_u, CASE WHEN draw_id % 4 >= 2 THEN 0.005e0 ELSE delta_k END AS delta_k, "
            "CASE WHEN draw_id % 4 = 3 THEN 0.05e0 ELSE tau_c_ss END AS tau_c_ss) FROM pr")


@register("steady_state_regions", sql(
    "SELECT pr.draw_id, CASE WHEN n_m > 1e-9 AND n_u > 0 THEN 'ok' ELSE 'no_interior' END AS status, "
    "coalesce(n_m > 1e-9, false) AS hours_positive, coalesce(n_m > 1e-9, false) AS adds_up "
    f"FROM pr LEFT JOIN ({steady_sql(_REGIONS)}) s USING (draw_id)", "pr"))
def steady_regions(spark, sf):
    k = F.col("draw_id") % 4
    rows = params(spark, sf).withColumns({
        "phi": F.when(k == 0, 2.0).when(k == 1, 2.5).otherwise(F.col("phi")),
        "xi": F.when(k == 0, 1.0).when(k == 1, 0.5).when(k == 3, 4.0).otherwise(F.col("xi")),
        "alpha": F.when(k >= 2, 0.40).otherwise(F.col("alpha")), "alpha_u": F.when(k >= 2, 0.40).otherwise(F.col("alpha_u")),
        "delta_k": F.when(k >= 2, 0.005).otherwise(F.col("delta_k")),
        "tau_c_ss": F.when(k == 3, 0.05).otherwise(F.col("tau_c_ss"))})
    used = F.col("c") + F.col("inv") + F.col("G_c") + F.col("G_h") + F.col("G_s")
    return steady_state(rows).select("draw_id", "status", F.coalesce((F.col("n_m") > 0) & (F.col("n_u") > 0), F.lit(False)).alias("hours_positive"),
                                     F.coalesce(F.abs(used - F.col("y")) < 1e-8 * F.col("y"), F.lit(False)).alias("adds_up"))


@register("size_table", sql(
    "SELECT draw_id, round(n_m + n_u, 6) AS hours, round(n_u/(n_m + n_u), 6) AS hours_share, "
    f"round(underground_share*100, 4) AS share_pct FROM ({steady_sql(_PR)})", "pr"))
def sizes(spark, sf):
    out = size_table(steady_state(params(spark, sf))).select("draw_id", "hours", "hours_share", "share_pct")
    return rounded(rounded(out, 6, "hours", "hours_share"), 4, "share_pct")


@register("total_revenue", sql(f"SELECT draw_id, round(G_c + G_h + G_s, 6) AS g_total FROM ({steady_sql(_PR)})", "pr"))
def revenue(spark, sf):
    return rounded(steady_state(params(spark, sf)).select("draw_id", total_revenue().alias("g_total")), 6, "g_total")


_B0_COEF = ("SELECT *, pow(gap/B_1, 1/phi) AS hu, CAST(0 AS DOUBLE) AS k1, sigma/phi AS k2, kapm*0.19e0 AS a1, "
            "(kapu - kapm)*hu AS a2, (ln(hu) - ln(0.19e0))/k2 AS l0, 60e0 AS h0 "
            f"FROM ({_tech(_PR)}) WHERE gap > 0")


@register("calibrate_b0", sql(
    f"SELECT draw_id, 'ok' AS b0_status, round(net*exp(-sigma*x)/pow(0.19e0, xi), 4) AS b0_star FROM ({_bisect(_B0_COEF)})", "pr"))
def calibrated(spark, sf):
    return rounded(calibrate_b0(params(spark, sf)).select("draw_id", "b0_status", "b0_star"), 4, "b0_star")


# -- scenarios -------------------------------------------------------------------------
_SCEN = ("SELECT pr.* REPLACE (coalesce(tc, tau_c_ss) AS tau_c_ss, coalesce(pp, p_ss) AS p_ss, coalesce(ts, tau_s_ss) AS tau_s_ss), "
         "scenario FROM pr, (VALUES ('base', NULL, NULL, NULL), ('cf1', 0.20e0, NULL, NULL), ('cf2', 0.30e0, NULL, NULL), "
         "('cf3', 0.20e0, 0.039e0, NULL), ('cf4', 0.30e0, NULL, 0.18e0)) t(scenario, tc, pp, ts)")


@register("scenario_overrides", sql(
    "SELECT draw_id, scenario, tau_c_ss, p_ss, tau_s_ss FROM sc WHERE scenario <> 'base'", "pr", sc=_SCEN))
def overrides(spark, sf):
    out = policy.apply_overrides(policy.cross_scenarios(params(spark, sf), policy.SCENARIOS))
    return out.select("draw_id", "scenario", "tau_c_ss", "p_ss", "tau_s_ss")


@register("scenario_table", sql(
    "SELECT draw_id, n_name AS scenario, CAST(0.10 AS DOUBLE) + CAST(0.01 AS DOUBLE)*n_nationkey AS tau_c_ss, "
    "CASE WHEN n_regionkey = 0 THEN CAST(0.03 AS DOUBLE) ELSE p_ss END AS p_ss FROM pr, nation", "pr"))
def scenario_table(spark, sf):
    """One scenario per nation, from a table."""
    share = F.lit(0.10) + F.lit(0.01) * F.col("n_nationkey")
    more = F.when(F.col("n_regionkey") == 0, F.create_map(F.lit("p_ss"), F.lit(0.03))).otherwise(F.expr("cast(map() as map<string,double>)"))
    scenarios = table(spark, sf, "nation").select(
        F.col("n_name").alias("scenario"), F.map_concat(F.create_map(F.lit("tau_c_ss"), share), more).alias("overrides"))
    out = policy.apply_overrides(policy.cross_scenarios(params(spark, sf), scenarios))
    return out.select("draw_id", "scenario", "tau_c_ss", "p_ss")


@register("range_table", sql(
    "SELECT draw_id, instrument, CAST(i AS INTEGER) AS i, round(lo + i*(hi - lo)/4, 9) AS grid_value FROM pr, "
    "(SELECT CASE r_regionkey WHEN 0 THEN 'tau_c_ss' WHEN 1 THEN 'tau_h_ss' WHEN 2 THEN 'tau_s_ss' WHEN 3 THEN 'p_ss' ELSE 'alpha' END "
    "AS instrument, CAST(0.01 AS DOUBLE)*(r_regionkey + 1) AS lo, CAST(0.1 AS DOUBLE)*(r_regionkey + 1) AS hi FROM region), range(5) t(i)", "pr"))
def range_table(spark, sf):
    """One instrument per region, from a table; the last is no tax."""
    at = F.col("r_regionkey").cast("int")
    names = F.array(*[F.lit(n) for n in ("tau_c_ss", "tau_h_ss", "tau_s_ss", "p_ss", "alpha")])
    ranges = table(spark, sf, "region").select(names[at].alias("instrument"), (0.01 * (at + 1)).alias("lo"), (0.1 * (at + 1)).alias("hi"))
    return rounded(policy.param_grid(params(spark, sf), ranges, 5).select("draw_id", "instrument", "i", "grid_value"), 9, "grid_value")


@register("unknown_overrides", "SELECT 'tau_x' AS name, count(*) AS n FROM part UNION ALL SELECT 'zeta', count(*) FROM part")
def unknown(spark, sf):
    wrong = [("one", {"tau_x": 1.0, "p_ss": 0.03}), ("two", {"zeta": 2.0})]
    return policy.unknown_overrides(policy.cross_scenarios(params(spark, sf), wrong))


_SOLVED = steady_sql("SELECT * FROM sc")


@register("pct_vs_baseline", sql(
    "SELECT s.draw_id, s.scenario, s.variable, round((s.value - b.value)/abs(b.value)*100, 3) + 0.0 AS pct FROM u s JOIN u b "
    "ON b.draw_id = s.draw_id AND b.variable = s.variable AND b.scenario = 'base' AND s.scenario <> 'base'", "pr", sc=_SCEN,
    u=f"UNPIVOT (SELECT draw_id, scenario, {', '.join(VARIABLES)} FROM ({_SOLVED})) ON {', '.join(VARIABLES)} INTO NAME variable VALUE value"))
def against_baseline(spark, sf):
    scenarios = [("base", {}), *policy.SCENARIOS]
    each = policy.cross_scenarios(spread(params(spark, sf), ["draw_id"]), scenarios)
    solved = steady_state(policy.apply_overrides(each))
    long = solved.select("draw_id", "scenario", *VARIABLES).unpivot(["draw_id", "scenario"], VARIABLES, "variable", "value")
    out = policy.pct_vs_baseline(long, ["draw_id", "variable"], "base")
    return out.select("draw_id", "scenario", "variable", "pct")


_LABEL_ROWS = ", ".join(f"({i}, '{v}', '{policy.POLICY_LABELS[v]}')"
                        for i, v in enumerate([*policy.REPORTED, "G_total", "ecv"]))
_PICK = "CASE variable " + " ".join(f"WHEN '{v}' THEN {{t}}.{v}" for v in policy.REPORTED) + \
        " WHEN 'G_total' THEN {t}.G_c + {t}.G_h + {t}.G_s END"


@register("counterfactual_table", sql(
    "SELECT draw_id, ord, variable, label, " + ", ".join(
        f"max(pct) FILTER (scenario = 'cf{i}') + 0.0 AS cf{i}_pct" for i in (1, 2, 3, 4)) +
    " FROM (SELECT draw_id, scenario, ord, variable, label, round(CASE WHEN variable = 'ecv' THEN 100*(exp(bu - su) - 1) "
    "ELSE 100*(sv - bv)/abs(bv) END, 3) AS pct FROM "
    f"(SELECT s.draw_id, s.scenario, v.*, {_PICK.format(t='s')} AS sv, {_PICK.format(t='b')} AS bv, s.utility AS su, "
    "b.utility AS bu FROM ss s JOIN ss b ON b.draw_id = s.draw_id AND b.scenario = 'base' AND s.scenario <> 'base', "
    f"(VALUES {_LABEL_ROWS}) v(ord, variable, label))) GROUP BY 1, 2, 3, 4", "pr", sc=_SCEN, ss=f"SELECT * FROM ({_SOLVED})"))
def counterfactuals(spark, sf):
    return policy.counterfactual_table(params(spark, sf), ["draw_id"])


@register("welfare_ecv", sql(
    "SELECT s.draw_id, s.scenario, round(s.utility/(1 - 0.997e0), 4) AS welfare, round(b.utility/(1 - 0.997e0), 4) AS base_welfare, "
    "round(exp(s.utility - b.utility) - 1, 6) + 0.0 AS ecv, round(exp(b.utility - s.utility) - 1, 6) + 0.0 AS ecv_reversed "
    "FROM ss s JOIN ss b ON b.draw_id = s.draw_id AND b.scenario = 'base' AND s.scenario <> 'base'",
    "pr", sc=_SCEN, ss=f"SELECT draw_id, scenario, utility FROM ({_SOLVED})"))
def welfare_ecv(spark, sf):
    both = policy.solve_scenarios(spread(params(spark, sf), ["draw_id"]))
    u0, u1, beta = F.col("base_utility"), F.col("utility"), F.col("beta")
    out = both.select("draw_id", "scenario", policy.welfare(u1, beta).alias("welfare"),
                      policy.welfare(u0, beta).alias("base_welfare"), policy.ecv(u0, u1, beta).alias("ecv"),
                      policy.ecv(u1, u0, beta).alias("ecv_reversed"))
    return rounded(rounded(out, 4, "welfare", "base_welfare"), 6, "ecv", "ecv_reversed")


@register("posterior_functional", sql(
    "SELECT scenario, count(rev) AS n, count(*) - count(rev) AS failed, round(avg(rev), 6) AS revenue_pct_mean, round(stddev_samp(rev), 6) AS revenue_pct_std, "
    "round(avg(ecv), 6) AS ecv_pct_mean, round(stddev_samp(ecv), 6) AS ecv_pct_std, round(avg(pp), 6) AS share_pp_mean, "
    "round(stddev_samp(pp), 6) AS share_pp_std, round(avg(CAST(rev >= 0 AS DOUBLE)), 6) AS self_financing_share FROM "
    "(SELECT s.scenario, 100*((s.G_c + s.G_h + s.G_s) - (b.G_c + b.G_h + b.G_s))/(b.G_c + b.G_h + b.G_s) AS rev, "
    "100*(exp(s.utility - b.utility) - 1) AS ecv, 100*(s.underground_share - b.underground_share) AS pp FROM ss s JOIN ss b "
    "ON b.draw_id = s.draw_id AND b.scenario = 'base' AND s.scenario <> 'base') GROUP BY 1",
    "pr", sc=_SCEN, ss=f"SELECT * FROM ({_SOLVED})"))
def functional(spark, sf):
    out = policy.posterior_functional(spread(params(spark, sf), ["draw_id"]))
    return rounded(out, 6, *[c for c in out.columns if c not in ("scenario", "n", "failed")])


@register("append_rows", sql(
    "SELECT draw_id, variable, round(value, 6) AS value FROM (" + " UNION ALL ".join(
        f"SELECT draw_id, '{v}' AS variable, {v} AS value FROM ss" for v in _ALL)
    + " UNION ALL SELECT draw_id, 'G_total', G_c + G_h + G_s FROM ss)",
    "pr", ss=f"SELECT * FROM ({steady_sql(_PR)})"))
def appended(spark, sf):
    solved = steady_state(params(spark, sf))
    rows = [solved.select("draw_id", F.lit(n).alias("variable"), v.alias("value"))
            for n, v in [*((v, F.col(v)) for v in _ALL), ("G_total", total_revenue())]]
    return rounded(policy.append_rows(*rows), 6, "value")


# -- from draws to policy: event types stand for five estimated parameters ----------------
_MAP = {"click": ("alpha", 0.64, 2000.0), "error": ("delta_k", 0.015, 10000.0), "purchase": ("alpha_u", 0.63, 2000.0),
        "signup": ("phi", 0.95, 1000.0), "view": ("xi", 1.90, 200.0)}
_MEANS = "SELECT run, " + ", ".join(
    f"{lo}e0 + avg(value) FILTER (param = '{e}')/{div}e0 AS {p}" for e, (p, lo, div) in _MAP.items()) + \
    ", 0.0255e0 AS p_ss, " + ", ".join(f"{v!r}::DOUBLE AS {k}" for k, v in CALIBRATED.items()) + " FROM dr2 GROUP BY 1"
_CUT = "SELECT * REPLACE (CASE WHEN scenario = 'base' THEN tau_c_ss ELSE 0.20e0 END AS tau_c_ss) FROM mn, " \
       "(VALUES ('base'), ('cut')) t(scenario)"


_CUT_BY_RUN = sql(
    "SELECT run, variable, round(CASE WHEN variable = 'ecv' THEN 100*(exp(bu - su) - 1) ELSE 100*(sv - bv)/abs(bv) END, 3) + 0.0 "
    f"AS cut_pct FROM (SELECT s.run, v.variable, {_PICK.format(t='s')} AS sv, {_PICK.format(t='b')} AS bv, s.utility AS su, "
    "b.utility AS bu FROM ss s JOIN ss b ON b.run = s.run AND b.scenario = 'base' AND s.scenario = 'cut', "
    f"(VALUES {_LABEL_ROWS}) v(ord, variable, label))", "dr2", mn=_MEANS, cu=_CUT, ss=f"SELECT * FROM ({steady_sql('SELECT * FROM cu')})")


@register("policy_from_draws_all", _CUT_BY_RUN)
@register("policy_from_draws", _CUT_BY_RUN)
def policy_from_draws(spark, sf):
    return _cut_by_run(spark, sf)


def _cut_by_run(spark, sf):
    """Every variable's change under the cut, per run, at the means of the run's draws."""
    d = draws(spark, sf, runs=True, numbered=False)
    value, name = F.lit(None).cast("double"), {}
    for event, (param, low, div) in _MAP.items():
        value = F.when(F.col("param") == event, low + F.col("value") / div).otherwise(value)
        name[event] = param
    d = d.withColumns({"value": value, "param": lookup(F.col("param"), name)})
    means = rows_from_means(posterior_summary(d), list(name.values())).withColumn("p_ss", F.lit(0.0255))
    table = policy.counterfactual_table(means, ["run"], [("cut", {"tau_c_ss": 0.20})])
    return table.select("run", "variable", "cut_pct")


# -- sweeps --------------------------------------------------------------------------------
_GRID_ROWS = ", ".join(f"('{p}', {lo}e0, {hi}e0)" for p, (lo, hi) in policy.RANGES.items())
_GRID = ("SELECT pr.*, instrument, CAST(i AS INTEGER) AS i, lo + i*(hi - lo)/24 AS grid_value FROM pr, "
         f"(VALUES {_GRID_ROWS}) t(instrument, lo, hi), (SELECT range AS i FROM range(25))")
_SWEPT = "SELECT * REPLACE (" + ", ".join(
    f"CASE WHEN instrument = '{p}' THEN grid_value ELSE {p} END AS {p}" for p in policy.RANGES) + \
    "), CASE instrument " + " ".join(f"WHEN '{p}' THEN {p}" for p in policy.RANGES) + " END AS base_value FROM gr"


@register("param_grid", sql("SELECT draw_id, instrument, i, round(grid_value, 9) AS grid_value FROM gr", "pr", gr=_GRID))
def grid(spark, sf):
    out = policy.param_grid(params(spark, sf)).select("draw_id", "instrument", "i", "grid_value")
    return rounded(out, 9, "grid_value")


@register("sweep", sql(
    "SELECT instrument, i, count(*) AS n, round(avg(y), 6) AS y, round(avg(underground_share), 6) AS share, round(avg(TE), 6) AS te, "
    "round(avg(G_c + G_h + G_s), 6) AS g_total, round(avg(utility/(1 - beta)), 4) AS welfare FROM ss GROUP BY 1, 2",
    "pr", gr=_GRID, sw=_SWEPT, ss=f"SELECT * FROM ({steady_sql('SELECT * FROM sw')})"))
def swept(spark, sf):
    out = policy.sweep(params(spark, sf), ["draw_id"]).filter("status = 'ok'").groupBy("instrument", "i").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), F.avg("underground_share").alias("share"),
        F.avg("TE").alias("te"), F.avg("G_total").alias("g_total"), F.avg("welfare").alias("welfare"))
    return rounded(rounded(out, 6, "y", "share", "te", "g_total"), 4, "welfare")


@register("laffer_peak", sql(
    "SELECT draw_id, instrument, round(peak_value, 6) AS peak_value, round(peak_revenue, 6) AS peak_revenue, "
    "round(base_value, 6) AS base_value, CASE WHEN base_value < peak_value THEN 'below' WHEN base_value > peak_value THEN 'above' "
    "ELSE 'at' END AS side FROM (SELECT draw_id, instrument, max_by(grid_value, G_c + G_h + G_s) AS peak_value, "
    "max(G_c + G_h + G_s) AS peak_revenue, max(base_value) AS base_value FROM ss GROUP BY 1, 2)",
    "pr", gr=_GRID, sw=_SWEPT, ss=f"SELECT * FROM ({steady_sql('SELECT * FROM sw')})"))
def peaks(spark, sf):
    out = policy.laffer_peak(policy.sweep(params(spark, sf), ["draw_id"]), ["draw_id"])
    return rounded(out, 6, "peak_value", "peak_revenue", "base_value")

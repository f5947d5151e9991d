"""Shock responses, contributions and auxiliary moments."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import labels, moments, shocks
from panelspark.operators.draws import posterior_quantiles
from panelspark.operators.series import dlog, long_to_wide
from panelspark.registry.base import contributions, quarterly, register, responses, rounded, sql, table
from panelspark.session import spread

_GROUPS = [("Productivitat", ["eps_a", "eps_b"]), ("Fiscal", ["eps_c", "eps_h", "eps_s"]), ("Inspeccio", ["eps_p"])]
_GROUP_CASE = "CASE component WHEN 'eps_a' THEN 'Productivitat' WHEN 'eps_c' THEN 'Fiscal' ELSE 'Inspeccio' END"
_RANK_CASE = "CASE component WHEN 'eps_a' THEN 0 WHEN 'eps_c' THEN 1 ELSE 2 END"


@register("fevd", sql(
    "SELECT run, variable, shock, round(100*s/sum(s) OVER (PARTITION BY run, variable), 2) AS share FROM "
    "(SELECT run, variable, shock, sum(value*value) AS s FROM ir GROUP BY 1, 2, 3)", "ir"))
def fevd(spark, sf):
    return shocks.fevd(responses(spark, sf))


@register("fevd_horizons", sql(
    "SELECT run, variable, shock, horizon, round(100*s/sum(s) OVER (PARTITION BY run, variable, horizon), 2) AS share FROM "
    "(SELECT run, variable, shock, horizon, sum(value*value) FILTER (h < horizon) AS s FROM ir, "
    "(VALUES (1), (4), (8), (20)) t(horizon) GROUP BY 1, 2, 3, 4)", "ir"))
def fevd_horizons(spark, sf):
    return shocks.fevd(responses(spark, sf), [1, 4, 8, 20])


@register("fevd_table", sql(
    "SELECT variable, " + ", ".join(f"max(share) FILTER (shock = '{p}') AS s{p[0]}" for p in
                                    ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))
    + " FROM (SELECT variable, shock, round(100*s/sum(s) OVER (PARTITION BY variable), 2) AS share FROM "
      "(SELECT variable, shock, sum(value*value) AS s FROM ir GROUP BY 1, 2)) GROUP BY 1", "ir"))
def fevd_table(spark, sf):
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = long_to_wide(shocks.fevd(responses(spark, sf)), ["variable"], "shock", "share", names)
    return wide.withColumnsRenamed({p: f"s{p[0]}" for p in names})


@register("group_contributions", sql(
    f'SELECT run, variable, t, {_GROUP_CASE} AS "group", round(sum(value), 2) AS contribution, {_RANK_CASE} AS rank '
    "FROM ct WHERE component IN ('eps_a', 'eps_c', 'eps_p') GROUP BY 1, 2, 3, 4, 6", "ct"))
def group_contributions(spark, sf):
    return rounded(shocks.group_contributions(contributions(spark, sf), _GROUPS), 2, "contribution")


@register("component_total", sql(
    "SELECT run, variable, t, round(sum(CASE WHEN component LIKE 'eps%' THEN value ELSE 0 END), 2) + 0.0 AS shocks, "
    "sum(value) FILTER (component = 'Initial_values') AS initial, "
    "round(sum(CASE WHEN component <> 'mean' THEN value ELSE 0 END), 2) + 0.0 AS total FROM ct GROUP BY 1, 2, 3", "ct"))
def component_total(spark, sf):
    return rounded(shocks.component_total(contributions(spark, sf)), 2, "shocks", "total")


@register("historical_stack", sql(
    "SELECT variable, t, \"group\", round(sum(greatest(c, 0)) OVER w, 2) + 0.0 AS pos_top, "
    "round(sum(least(c, 0)) OVER w, 2) + 0.0 AS neg_top FROM "
    f"(SELECT variable, t, {_GROUP_CASE} AS \"group\", {_RANK_CASE} AS rank, sum(value) AS c FROM ct "
    "WHERE component IN ('eps_a', 'eps_c', 'eps_p') GROUP BY 1, 2, 3, 4) "
    "WINDOW w AS (PARTITION BY variable, t ORDER BY rank ROWS UNBOUNDED PRECEDING)", "ct"))
def historical_stack(spark, sf):
    from panelspark.operators.series import signed_stack
    grouped = shocks.group_contributions(contributions(spark, sf), _GROUPS)
    out = signed_stack(grouped, ["run", "variable", "t"], "rank", "contribution")
    return rounded(out.select("variable", "t", "group", "pos_top", "neg_top"), 2, "pos_top", "neg_top")


_DATE = "make_date(CAST(t // 4 AS INTEGER), CAST(t % 4 AS INTEGER)*3 + 1, 1)"
_STACKED = ", ".join(f"round({x}, 2) + 0.0 AS {n}" for n, x in (
    ("pos_bottom", "sum(greatest(c, 0)) OVER w - greatest(c, 0)"), ("pos_top", "sum(greatest(c, 0)) OVER w"),
    ("neg_bottom", "sum(least(c, 0)) OVER w - least(c, 0)"), ("neg_top", "sum(least(c, 0)) OVER w")))


@register("historical_decomposition", sql(
    f"SELECT run, variable, CAST(t AS INTEGER) AS t, {_DATE} AS date, CASE WHEN t % 4 = 0 AND (t = (SELECT min(t) FROM ct) OR (t // 4) % 4 = 0) "
    "THEN CAST(t // 4 AS VARCHAR) END AS tick, part, CAST(coalesce(rank, -1) AS INTEGER) AS rank, round(c, 2) + 0.0 AS value, pos_bottom, pos_top, neg_bottom, "
    "neg_top FROM (SELECT * FROM bars UNION ALL BY NAME SELECT * FROM ini UNION ALL BY NAME SELECT * FROM tot)", "ct",
    gr=f"SELECT run, variable, t, {_GROUP_CASE} AS part, {_RANK_CASE} AS rank, sum(value) AS c FROM ct "
       "WHERE component IN ('eps_a', 'eps_c', 'eps_p') GROUP BY 1, 2, 3, 4, 5",
    bars=f"SELECT *, {_STACKED} FROM gr WINDOW w AS (PARTITION BY run, variable, t ORDER BY rank ROWS UNBOUNDED PRECEDING)",
    ini="SELECT run, variable, t, 'initial' AS part, sum(value) AS c, 0.0::DOUBLE AS pos_bottom, round(greatest(sum(value), 0), 2) + 0.0 AS pos_top, "
        "0.0::DOUBLE AS neg_bottom, round(least(sum(value), 0), 2) + 0.0 AS neg_top FROM ct WHERE component = 'Initial_values' GROUP BY 1, 2, 3",
    tot="SELECT run, variable, t, 'total' AS part, coalesce(sum(value) FILTER (component <> 'mean'), 0) AS c FROM ct GROUP BY 1, 2, 3"))
def historical_decomposition(spark, sf):
    from panelspark.plans.decomposition import STACK
    from panelspark.plans.decomposition import historical_decomposition as plan
    contrib = contributions(spark, sf)
    quarters = contrib.select("t").distinct()
    dates = quarters.withColumn("date", F.make_date(F.floor(F.col("t") / 4).cast("int"), F.col("t") % 4 * 3 + 1, F.lit(1)))
    drawn = plan(contrib, dates, _GROUPS)
    return rounded(drawn.withColumn("rank", F.coalesce("rank", F.lit(-1))), 2, "value", *STACK)


def _daily(spark, sf):
    e = table(spark, sf, "events")
    path = e.groupBy(F.lit("all").alias("run"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("variable"),
                     F.col("event_type").alias("shock"), F.hour("ts").alias("h")).agg(
        (F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / 1000).alias("value"))
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    hits = e.groupBy(F.lit("all").alias("run"), F.col("event_type").alias("shock"), day.alias("t")).agg(
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))
    return path, hits


@register("shock_convolution", sql(
    "SELECT e.run, e.shock, p.variable, CAST(e.t + p.h AS INTEGER) AS t, round(sum(e.value*p.value), 4) AS value "
    "FROM e JOIN p USING (run, shock) WHERE e.t + p.h <= (SELECT max(t) FROM e) GROUP BY 1, 2, 3, 4",
    e="SELECT 'all' AS run, event_type AS shock, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t, "
      "CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY 1, 2, 3",
    p="SELECT 'all' AS run, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS variable, event_type AS shock, "
      "hour(ts) AS h, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE)/1000 AS value FROM events GROUP BY 1, 2, 3, 4"))
def shock_convolution(spark, sf):
    path, hits = _daily(spark, sf)
    last = hits.agg(F.max("t")).first()[0]    # the path ends with the last shock
    return rounded(shocks.shock_convolution(path, hits, t_max=last), 4, "value")


@register("half_life", sql(
    "SELECT p_partkey AS draw_id, rho, round(ln(0.5)/ln(rho), 6) AS half_life FROM "
    "(SELECT p_partkey, CAST(0.5 AS DOUBLE) + CAST(0.0095 AS DOUBLE)*p_size AS rho FROM part)"))
def half_life(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("draw_id"), (0.5 + 0.0095 * F.col("p_size")).alias("rho"))
    return rounded(p.withColumn("half_life", shocks.half_life(F.col("rho"))), 6, "half_life")


@register("ar1_irf", sql(
    "SELECT p_partkey AS draw_id, h, round((1 + p_partkey % 7)/11.0e0*pow(CAST(0.5 AS DOUBLE) + CAST(0.0095 AS DOUBLE)*p_size, h), 9) "
    "AS response FROM part, (SELECT CAST(range AS INTEGER) AS h FROM range(13))"))
def ar1_irf(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("draw_id"), (0.5 + 0.0095 * F.col("p_size")).alias("rho"),
        ((1 + F.col("p_partkey") % 7) / 11.0).alias("sigma"))
    return rounded(shocks.ar1_irf(p, "rho", "sigma", 12).select("draw_id", "h", "response"), 9, "response")


@register("irf_bands", sql(
    "SELECT h, round(quantile_cont(r, 0.025), 6) AS q025, round(quantile_cont(r, 0.5), 6) AS q50, "
    "round(quantile_cont(r, 0.975), 6) AS q975 FROM (SELECT h, (1 + p_partkey % 7)/11.0e0*pow(CAST(0.5 AS DOUBLE) + "
    "CAST(0.0095 AS DOUBLE)*p_size, h) AS r FROM part, (SELECT CAST(range AS INTEGER) AS h FROM range(41))) GROUP BY 1"))
def irf_bands(spark, sf):
    """Bands over a given table of responses."""
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("draw_id"), (0.5 + 0.0095 * F.col("p_size")).alias("rho"),
        ((1 + F.col("p_partkey") % 7) / 11.0).alias("sigma"))
    paths = shocks.ar1_irf(spread(p, ["draw_id"]), "rho", "sigma", 40).withColumnRenamed("response", "value")
    bands = posterior_quantiles(paths, ["h"], {"q025": 0.025, "q50": 0.5, "q975": 0.975})
    return rounded(bands, 6, "q025", "q50", "q975")


_CANON = ["click", "err", "error", "pur", "sign", "signup", "view"]


@register("shock_name_match", sql(
    "SELECT event_type || '₍ₓ₎' AS name, CASE event_type WHEN 'click' THEN 'click' WHEN 'error' THEN 'error' "
    "WHEN 'signup' THEN 'signup' WHEN 'view' THEN 'view' END AS canonical, count(*) AS n FROM events GROUP BY 1, 2"))
def shock_name_match(spark, sf):
    named = table(spark, sf, "events").select(F.concat(F.col("event_type"), F.lit("₍ₓ₎")).alias("name"))
    return (named.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("canonical", labels.match_shock_name(F.col("name"), _CANON)))


# -- auxiliary moments ---------------------------------------------------------------------
_PANEL = ("SELECT series_key, quarter_idx, max(g) FILTER (o_orderstatus = 'F') AS gf, max(g) FILTER (o_orderstatus = 'O') AS go "
          "FROM (SELECT *, ln(v) - lag(ln(v)) OVER (PARTITION BY series_key, o_orderstatus ORDER BY quarter_idx) AS g FROM q5s) "
          "WHERE g IS NOT NULL GROUP BY 1, 2")
_THREE = ["gf", "go", "gp"]
_PANEL3 = _PANEL.replace(" AS go FROM", " AS go, max(g) FILTER (o_orderstatus = 'P') AS gp FROM")
_GRAM3 = ("SELECT series_key, sum(lf*lf) AS a, sum(lf*lo) AS b, sum(lf*lp) AS c, sum(lo*lo) AS d, sum(lo*lp) AS e, sum(lp*lp) AS f, "
          + ", ".join(f"sum(l{x}*g{y}) AS {x}{y}" for y in "fop" for x in "fop")
          + " FROM (SELECT *, " + ", ".join(f"lag(g{x}) OVER w AS l{x}" for x in "fop")
          + " FROM panel WINDOW w AS (PARTITION BY series_key ORDER BY quarter_idx)) WHERE "
          + " AND ".join(f"{c} IS NOT NULL" for c in ("gf", "go", "gp", "lf", "lo", "lp")) + " GROUP BY 1")
_ADJ3 = ("SELECT *, a*i11 + b*i12 + c*i13 AS det FROM (SELECT *, d*f - e*e AS i11, c*e - b*f AS i12, b*e - c*d AS i13, "
         "a*f - c*c AS i22, b*c - a*e AS i23, a*d - b*b AS i33 FROM gram)")
_COEF3 = " UNION ALL ".join(
    f"SELECT series_key, {3 * j + i} AS pos, '{_THREE[i]}' AS predictor, '{_THREE[j]}' AS target, "
    f"({r[0]}*f{y} + {r[1]}*o{y} + {r[2]}*p{y})/det AS coef FROM adj"
    for j, y in enumerate("fop") for i, r in enumerate((("i11", "i12", "i13"), ("i12", "i22", "i23"), ("i13", "i23", "i33"))))


def _panel(spark, sf):
    """Growth by status, one column each."""
    q = quarterly(spark, sf, "o_orderstatus")
    growth = dlog(q, ["series_key", "o_orderstatus"], {"g": "v"}, scale=1.0)
    names = {"F": "gf", "O": "go", "P": "gp"}
    return long_to_wide(growth, ["series_key", "quarter_idx"], "o_orderstatus", "g", list(names)).withColumnsRenamed(names)


_COEF_SQL = sql("SELECT series_key, pos, predictor, target, round(coef, 6) AS coef FROM coef", "q5s",
                panel=_PANEL3, gram=_GRAM3, adj=_ADJ3, coef=_COEF3)


@register("var1_ols_statuses", _COEF_SQL)
@register("var1_ols", _COEF_SQL)
def var1_ols(spark, sf):
    return rounded(moments.var1_ols(_panel(spark, sf), ["series_key"], _THREE), 6, "coef")


def _distances(coef, digits: int = 6, **how):
    """Distance of every series' moments to those of the first; one series is out of bounds."""
    target = coef.filter("series_key = '1-URGENT'").withColumn("w", (1 + F.col("pos")).cast("double"))
    theta = coef.withColumns({"alpha": F.lit(0.33), "beta": F.lit(0.99), "delta": F.lit(0.025), "gamma": F.lit(2.0),
                              "rho": F.when(F.col("series_key") == "5-LOW", 1.0).otherwise(0.95)})
    theta = theta.withColumn("out_of_bounds", moments.out_of_bounds())
    return rounded(moments.moment_distance(theta, target, ["series_key"], **(how or {"weight": "w"})), digits, "distance")


_DISTANCE_SQL = sql(
    "SELECT s.series_key, CASE WHEN s.series_key = '5-LOW' THEN 1e6 ELSE round(sum((1 + s.pos)*pow(s.coef - t.coef, 2)), 6) END "
    "AS distance FROM coef s JOIN coef t ON t.series_key = '1-URGENT' AND t.pos = s.pos GROUP BY 1", "q5s",
    panel=_PANEL3, gram=_GRAM3, adj=_ADJ3, coef=_COEF3)


@register("moment_distance_statuses", _DISTANCE_SQL)
@register("moment_distance", _DISTANCE_SQL)
def moment_distance(spark, sf):
    return _distances(moments.var1_ols(_panel(spark, sf), ["series_key"], _THREE))


# -- moment distance with the inverse long-run covariance as its matrix ---------------------------------
_LAGS = 4
_RESID3 = {y: f"g{y} - (" + " + ".join(f"b{3 * j + i}*l{x}" for i, x in enumerate("fop")) + ")" for j, y in enumerate("fop")}
_LONG_RUN = {
    "panel": _PANEL3, "gram": _GRAM3, "adj": _ADJ3, "coef": _COEF3,
    "b": "SELECT series_key, " + ", ".join(f"max(coef) FILTER (pos = {p}) AS b{p}" for p in range(9)) + " FROM coef GROUP BY 1",
    "lagged": "SELECT *, " + ", ".join(f"lag(g{x}) OVER w AS l{x}" for x in "fop")
              + " FROM panel WINDOW w AS (PARTITION BY series_key ORDER BY quarter_idx)",
    "full_rows": "SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY quarter_idx) AS t FROM lagged JOIN b USING (series_key) "
                 "WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in ("gf", "go", "gp", "lf", "lo", "lp")),
    "score": " UNION ALL ".join(f"SELECT series_key, t, {3 * j + i} AS pos, l{x}*({_RESID3[y]}) AS s FROM full_rows"
                                for j, y in enumerate("fop") for i, x in enumerate("fop")),
    "long_run": "SELECT a.series_key, a.pos AS p, b.pos AS q, "
                f"sum((1 - abs(a.t - b.t)/{_LAGS + 1}e0)*a.s*b.s) AS v FROM score a JOIN score b ON a.series_key = b.series_key "
                f"AND abs(a.t - b.t) <= {_LAGS} GROUP BY 1, 2, 3",
    "bread": " UNION ALL ".join(f"SELECT series_key, {i} AS i, {j} AS j, i{min(i, j) + 1}{max(i, j) + 1}/det AS v FROM adj"
                                for i in range(3) for j in range(3)),
    "cov": "SELECT s.series_key, (s.p // 3)*3 + l.i AS pos_a, (s.q // 3)*3 + r.j AS pos_b, sum(l.v*s.v*r.v) AS cov FROM long_run s "
           "JOIN bread l ON l.series_key = s.series_key AND l.j = s.p % 3 "
           "JOIN bread r ON r.series_key = s.series_key AND r.i = s.q % 3 GROUP BY 1, 2, 3",
}


def _coefficient_covariance(spark, sf):
    return moments.moment_covariance(_panel(spark, sf), ["series_key"], _THREE, _LAGS)


@register("moment_covariance", sql(
    "SELECT series_key, CAST(pos_a AS INTEGER) AS pos_a, CAST(pos_b AS INTEGER) AS pos_b, round(cov, 8) AS cov FROM cov", "q5s", **_LONG_RUN))
def moment_covariance(spark, sf):
    return rounded(_coefficient_covariance(spark, sf).drop("weight"), 8, "cov")


# elimination over the rows (covariance of the first series | gaps of every series), one pivot a step
_SOLVE = (
    "SELECT 0 AS step, i, j, v FROM start UNION ALL SELECT step + 1, i, j, CASE WHEN i = step THEN v/p ELSE v - c*r/p END FROM ("
    "SELECT *, max(v) FILTER (i = step AND j = CAST(step AS VARCHAR)) OVER () AS p, "
    "max(v) FILTER (j = CAST(step AS VARCHAR)) OVER (PARTITION BY i) AS c, max(v) FILTER (i = step) OVER (PARTITION BY j) AS r "
    "FROM solve) WHERE step < 9")
_GAPS = "SELECT s.series_key, s.pos, s.coef - t.coef AS d FROM coef s JOIN coef t ON t.series_key = '1-URGENT' AND t.pos = s.pos"


@register("moment_distance_matrix", sql(
    "SELECT g.series_key, CASE WHEN g.series_key = '5-LOW' THEN 1e6 ELSE round(sum(g.d*s.v), 4) END AS distance FROM gaps g "
    "JOIN solve s ON s.step = 9 AND s.j = g.series_key AND s.i = g.pos GROUP BY 1", "q5s", **_LONG_RUN, gaps=_GAPS,
    start="SELECT pos_a AS i, CAST(pos_b AS VARCHAR) AS j, cov AS v FROM cov WHERE series_key = '1-URGENT' "
          "UNION ALL SELECT pos, series_key, d FROM gaps",
    solve=_SOLVE).replace("WITH ", "WITH RECURSIVE ", 1))
def moment_distance_matrix(spark, sf):
    weights = _coefficient_covariance(spark, sf).filter("series_key = '1-URGENT'").drop("series_key")
    return _distances(moments.var1_ols(_panel(spark, sf), ["series_key"], _THREE), matrix=weights, digits=4)

"""Scenarios, parameter sweeps and welfare over tables of parameter rows.

A baseline row, its scenarios and its grid points stay in one partition: the
row is solved once, exploded, overridden and solved again, without a join.
Tables per id hash the parameter rows by id first (``spread``), one row each, so
the many results of a row meet again in the partial aggregate of their own task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.labels import POLICY_LABELS, lookup
from panelspark.operators.steady import PARAMS, VARIABLES, steady_state, total_revenue
from panelspark.session import spread, written

# The four policy scenarios.
SCENARIOS = [
    ("cf1", {"tau_c_ss": 0.20}),
    ("cf2", {"tau_c_ss": 0.30}),
    ("cf3", {"tau_c_ss": 0.20, "p_ss": 0.039}),
    ("cf4", {"tau_c_ss": 0.30, "tau_s_ss": 0.18}),
]
# Instrument ranges of the revenue curves.
RANGES = {
    "tau_c_ss": (0.05, 0.70),
    "tau_h_ss": (0.05, 0.65),
    "tau_s_ss": (0.02, 0.50),
    "p_ss": (0.001, 0.15),
}
REPORTED = VARIABLES[:10]
GRID_POINTS = 25
COPIES = 64    # numbers a table of definitions is dealt out under


def scenario_array(scenarios: list) -> Column:
    """Scenario list ``(name, {param: value})`` as an array literal of (scenario, overrides)."""
    def one(name: str, overrides: dict) -> Column:
        pairs = [x for k, v in overrides.items() for x in (F.lit(k), F.lit(float(v)))]
        m = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,double>)")
        return F.struct(F.lit(name).alias("scenario"), m.alias("overrides"))
    return F.array(*[one(n, o) for n, o in scenarios])


def _with_every(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Every row of ``df`` beside every row of a table of definitions.

    Each definition is dealt out ``COPIES`` times under a number, each row of ``df`` draws one of the numbers, and
    an equality on it brings them together: an even join whatever the definitions, broadcast if their
    stored table is small, and a plan that does not grow with them.
    """
    copies = written(rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))), "definitions")
    return df.withColumn("_copy", F.pmod(F.monotonically_increasing_id(), F.lit(COPIES)).cast("int")).join(copies, "_copy").drop("_copy")


def cross_scenarios(params: DataFrame, scenarios: list | DataFrame) -> DataFrame:
    """Every parameter row with every scenario; adds ``scenario`` and ``overrides``.

    ``scenarios`` is a list, or a table ``(scenario, overrides)`` with a map from parameter to value.
    """
    if isinstance(scenarios, DataFrame):
        return _with_every(params, scenarios.select("scenario", F.col("overrides").cast("map<string,double>")))
    return params.select("*", F.inline(scenario_array(scenarios)))


def apply_overrides(df: DataFrame, overrides: str = "overrides", names: list = PARAMS,
                    defaults: dict | None = None) -> DataFrame:
    """Replace parameters by the entries of a map column.

    The map wins over the row, the row over ``defaults``; names outside
    ``names`` are ignored (see ``unknown_overrides``).
    """
    defaults = defaults or {}
    cols = {}
    for n in names:
        chain = [f"try_element_at(`{overrides}`, '{n}')"]
        chain += [n] if n in df.columns else []
        chain += [f"{float(defaults[n])!r}D"] if defaults.get(n) is not None else []
        cols[n] = F.expr(f"coalesce({', '.join(chain)})")
    return df.withColumns(cols)


def unknown_overrides(df: DataFrame, overrides: str = "overrides", names: list = PARAMS) -> DataFrame:
    """Override names that no parameter has, with the number of rows that carry them."""
    keys = df.select(F.explode(F.map_keys(overrides)).alias("name"))
    return keys.filter(~F.col("name").isin(*names)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def pct_change(x: Column, base: Column) -> Column:
    """``(x - base) / |base| * 100``; null when the base is missing, NaN or zero."""
    return F.when(~F.isnan(base) & (base != 0), (x - base) / F.abs(base) * 100)


def pct_vs_baseline(df: DataFrame, keys: list, baseline: str, scenario: str = "scenario", value: str = "value",
                    name: str = "pct", digits: int | None = 3) -> DataFrame:
    """Percentage change against the baseline scenario of the same key, in one shuffle."""
    w = Window.partitionBy(*keys)
    base = F.max(F.when(F.col(scenario) == baseline, F.col(value))).over(w)
    pct = pct_change(F.col(value), F.col("_base"))
    out = df.withColumn("_base", base).withColumn(name, pct if digits is None else F.round(pct, digits))
    return out.filter(F.col(scenario) != baseline).drop("_base")


def welfare(utility: Column, beta: Column) -> Column:
    """Discounted steady-state welfare ``U / (1 - beta)``."""
    return F.try_divide(utility, 1 - beta)


def ecv(base_utility: Column, alt_utility: Column, beta: Column) -> Column:
    """Consumption equivalent of moving from ``base`` to ``alt``; positive if ``alt`` is better.

    ``exp((1-beta)(W_alt - W_base)) - 1``.  Swapping the arguments gives the
    reversed measure, ``1/(1+ecv) - 1``.
    """
    gap = welfare(alt_utility, beta) - welfare(base_utility, beta)
    return F.exp((1 - beta) * gap) - 1


def solve_scenarios(params: DataFrame, scenarios: list | DataFrame = SCENARIOS) -> DataFrame:
    """Baseline (``base_`` columns) and scenario solution of every row and scenario."""
    solved = steady_state(params, "base_")
    return steady_state(apply_overrides(cross_scenarios(solved, scenarios)))


def scenario_changes(params: DataFrame, ids: list, scenarios: list | DataFrame = SCENARIOS, reversed_ecv: bool = True,
                     digits: int | None = 3) -> DataFrame:
    """Long table ``(ids, scenario, ord, variable, pct)`` in report order.

    Covers the reported variables, total revenue and the consumption equivalent
    (with ``reversed_ecv`` in the direction of the published table).
    """
    both = solve_scenarios(params, scenarios)
    u0, u1, beta = F.col("base_utility"), F.col("utility"), F.col("beta").cast("double")
    ecv_pct = 100 * (ecv(u1, u0, beta) if reversed_ecv else ecv(u0, u1, beta))
    changes = [(v, pct_change(F.col(v), F.col(f"base_{v}"))) for v in REPORTED]
    solved = (F.col("status") == "ok") & (F.col("base_status") == "ok")
    changes.append(("G_total", F.when(solved, pct_change(total_revenue(), total_revenue("base_")))))
    changes.append(("ecv", ecv_pct))
    rows = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(v).alias("variable"),
                 (p if digits is None else F.round(p, digits)).alias("pct"))
        for i, (v, p) in enumerate(changes)])
    return both.select(*ids, "scenario", F.inline(rows))


def counterfactual_table(params: DataFrame, ids: list, scenarios: list = SCENARIOS, reversed_ecv: bool = True,
                         digits: int | None = 3) -> DataFrame:
    """One row per id and variable with a ``<scenario>_pct`` column per scenario."""
    names = [n for n, _ in scenarios]
    long = scenario_changes(spread(params, ids), ids, scenarios, reversed_ecv, digits)
    wide = long.groupBy(*ids, "ord", "variable").agg(
        *[F.max(F.when(F.col("scenario") == n, F.col("pct"))).alias(f"{n}_pct") for n in names])
    return wide.select(*ids, "ord", "variable", F.coalesce(lookup(F.col("variable"), POLICY_LABELS), "variable").alias("label"),
                       *[f"{n}_pct" for n in names])


def append_rows(*tables: DataFrame) -> DataFrame:
    """Stack result tables by column name; columns absent from one become null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def grid_value(lo: Column, hi: Column, i: Column, n: int) -> Column:
    return lo + i * (hi - lo) / (n - 1)


def param_grid(df: DataFrame, ranges: dict | DataFrame = RANGES, n: int = GRID_POINTS) -> DataFrame:
    """Equally spaced values per instrument, both ends included; adds ``instrument, i, grid_value``.

    ``ranges`` is a dict, or a table ``(instrument, lo, hi)``.
    """
    if isinstance(ranges, DataFrame):
        out = _with_every(df, ranges.select("instrument", F.col("lo").cast("double").alias("_lo"), F.col("hi").cast("double").alias("_hi")))
    else:
        each = F.array(*[F.struct(F.lit(p).alias("instrument"), F.lit(float(lo)).alias("_lo"), F.lit(float(hi)).alias("_hi"))
                         for p, (lo, hi) in ranges.items()])
        out = df.select("*", F.inline(each))
    out = out.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.withColumn("grid_value", grid_value(F.col("_lo"), F.col("_hi"), F.col("i"), n)).drop("_lo", "_hi")


def sweep(params: DataFrame, ids: list, ranges: dict | DataFrame = RANGES, n: int = GRID_POINTS) -> DataFrame:
    """Replace one instrument at a time by every grid value and solve again.

    A table of ``ranges`` may name any parameter.

    Adds ``base_value`` (the row's own rate), the solution, ``G_total`` and
    ``welfare``.  A failed point keeps its row with nulls and a ``status``.
    """
    grid = param_grid(spread(params, ids), ranges, n)
    names = [p for p in PARAMS if p in params.columns] if isinstance(ranges, DataFrame) else list(ranges)
    own = F.coalesce(*[F.when(F.col("instrument") == p, F.col(p)) for p in names])
    grid = grid.withColumn("base_value", own)
    grid = grid.withColumns({p: F.when(F.col("instrument") == p, F.col("grid_value")).otherwise(F.col(p)) for p in names})
    out = steady_state(grid)
    return out.withColumns({
        "G_total": F.when(F.col("status") == "ok", total_revenue()),
        "welfare": welfare(F.col("utility"), F.col("beta").cast("double"))})


def laffer_peak(swept: DataFrame, ids: list) -> DataFrame:
    """Revenue-maximising rate per instrument and the side of the peak the baseline is on.

    Ties go to the lowest rate.
    """
    ok = swept.filter(F.col("G_total").isNotNull() & ~F.isnan("G_total"))
    peak = ok.groupBy(*ids, "instrument").agg(
        F.max(F.struct("G_total", (-F.col("grid_value")).alias("neg"))).alias("_top"),
        F.max("base_value").alias("base_value"))
    at = -F.col("_top.neg")
    side = F.when(F.col("base_value") < at, "below").when(F.col("base_value") > at, "above").otherwise("at")
    return peak.select(*ids, "instrument", at.alias("peak_value"), F.col("_top.G_total").alias("peak_revenue"),
                       "base_value", side.alias("side"))


def posterior_functional(params: DataFrame, scenarios: list | DataFrame = SCENARIOS) -> DataFrame:
    """Over all draws: mean and spread of the share and revenue effects, and how often revenue does not fall.

    ``n`` draws have a solution with and without the scenario; ``failed`` counts the others, which the statistics leave out.
    """
    both = solve_scenarios(params, scenarios)
    solved = (F.col("status") == "ok") & (F.col("base_status") == "ok")
    revenue = pct_change(total_revenue(), total_revenue("base_"))
    gain = ecv(F.col("base_utility"), F.col("utility"), F.col("beta").cast("double")) * 100
    per = both.select("scenario", solved.alias("_solved"), *[F.when(solved, c).alias(n) for n, c in (
        ("revenue_pct", revenue), ("ecv_pct", gain), ("share_pp", 100 * (F.col("underground_share") - F.col("base_underground_share"))))])
    stats = []
    for c in ("revenue_pct", "ecv_pct", "share_pp"):
        stats += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return per.groupBy("scenario").agg(
        F.count(F.when(F.col("_solved"), 1)).alias("n"), F.count(F.when(~F.coalesce("_solved", F.lit(False)), 1)).alias("failed"), *stats,
        F.avg((F.col("revenue_pct") >= 0).cast("double")).alias("self_financing_share"))

"""Shock responses: variance shares, contributions, convolution, response paths."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.labels import INITIAL, NON_SHOCKS, SHOCK_GROUPS, is_component_shock, lookup, match_shock_name

OTHER = "other"    # shocks of no group
BLOCK = 1 << 12    # dates, and horizons, convolved at once


def fevd(irf: DataFrame, horizons: list | None = None, keys: list = ("run", "variable"), shock: str = "shock",
         h: str = "h", value: str = "value", digits: int | None = 2) -> DataFrame:
    """Share of each shock in the forecast error variance, in percent.

    ``horizons`` adds ``horizon`` (periods 0..H-1 each); without it all periods
    count, which is the long-run table.  The sums for all horizons come out of
    one aggregation.
    """
    keys = list(keys)
    sq = F.col(value) * F.col(value)
    if horizons is None:
        parts = [F.struct(F.lit(None).cast("int").alias("horizon"), F.col("_s").alias("_v"))]
        sums = irf.groupBy(*keys, shock).agg(F.sum(sq).alias("_s"))
    else:
        sums = irf.groupBy(*keys, shock).agg(
            *[F.sum(F.when(F.col(h) < H, sq).otherwise(0.0)).alias(f"_s{H}") for H in horizons])
        parts = [F.struct(F.lit(H).alias("horizon"), F.col(f"_s{H}").alias("_v")) for H in horizons]
    long = sums.select(*keys, shock, F.inline(F.array(*parts)))
    everything = F.sum("_v").over(Window.partitionBy(*keys, "horizon"))  # one row per shock
    share = F.try_divide(100 * F.col("_v"), everything)
    out = long.select(*keys, shock, "horizon", (share if digits is None else F.round(share, digits)).alias("share"))
    return out.drop("horizon") if horizons is None else out


def group_contributions(contrib: DataFrame, groups: list = SHOCK_GROUPS, keys: list = ("run", "variable", "t"),
                        component: str = "component", value: str = "value") -> DataFrame:
    """Contributions added up by shock group, with the group's stacking rank.

    Decorated names count for the shock they decorate.  Shocks of no group form the
    group ``other``, ranked last, so the groups add up to the sum of all shocks.
    """
    name = {s: g for g, shocks in groups for s in shocks}
    rank = {g: i for i, (g, _) in enumerate([*groups, (OTHER, ())])}
    found = lookup(match_shock_name(F.col(component), list(name)), name)
    labelled = contrib.filter(is_component_shock(F.col(component))).withColumn("group", F.coalesce(found, F.lit(OTHER)))
    return (labelled.groupBy(*keys, "group").agg(F.sum(value).alias("contribution"))
            .withColumn("rank", lookup(F.col("group"), rank)))


def component_total(contrib: DataFrame, keys: list = ("run", "variable", "t"), component: str = "component",
                    value: str = "value") -> DataFrame:
    """Sum of shocks and, where present, initial conditions; mean and constant stay out.

    ``Initial_values`` goes before ``initial_conditions`` when a table has both.
    """
    c = F.col(component)
    shocks = F.sum(F.when(is_component_shock(c), F.col(value)))
    first, second = (F.sum(F.when(c == n, F.col(value))) for n in INITIAL)
    return contrib.groupBy(*keys).agg(
        F.coalesce(shocks, F.lit(0.0)).alias("shocks"), F.coalesce(first, second).alias("initial")
    ).withColumn("total", F.col("shocks") + F.coalesce("initial", F.lit(0.0)))


def _dense(first: int, at: list, values: list) -> tuple[np.ndarray, np.ndarray]:
    where = np.asarray(at, np.int64) - first
    dense, present = np.zeros(where.max() + 1), np.zeros(where.max() + 1)
    dense[where], present[where] = values, 1.0
    return dense, present


def _convolve(block: int, out: list, t_max: int | None):
    """Block of shocks times block of responses: the dates they reach, a row each."""
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                lo, at_h = row["_tb"] * block, row["_hb"] * block
                e, dated = _dense(lo, [x["t"] for x in row["_shocks"]], [x["v"] for x in row["_shocks"]])
                r, known = _dense(at_h, [x["h"] for x in row["_path"]], [x["v"] for x in row["_path"]])
                odd_e, odd_r = ~np.isfinite(e), ~np.isfinite(r)
                value = np.convolve(np.where(odd_e, 0, e), np.where(odd_r, 0, r))
                hit = np.convolve(dated, known) > 0.5
                if odd_e.any() or odd_r.any():    # a date without a number spoils the dates it reaches, no others
                    value[np.convolve(odd_e * 1.0, known) + np.convolve(dated, odd_r * 1.0) > 0.5] = np.nan
                t = np.flatnonzero(hit)
                when = t + lo + at_h
                if t_max is not None:
                    t, when = t[when <= t_max], when[when <= t_max]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([row[c]] * len(t), b.schema.field(c).type) for c in out), pa.array(when, pa.int64()), pa.array(value[t])],
                    names=[*out, "_t", "_v"])
    return run


def shock_convolution(irf: DataFrame, shocks: DataFrame, keys: list = ("run", "shock"), t: str = "t",
                      t_max: int | None = None, block: int = BLOCK) -> DataFrame:
    """Contribution of each shock to each variable: responses weighted by past shocks.

    ``sum over h of irf(h) * shock(t-h)`` by overlap-add: dates and horizons are cut into blocks of ``block``, every
    block of shocks is convolved with every block of responses of its keys in one go, and the pieces that
    reach over a block's end are added to the next.  A pair of blocks costs two blocks of rows, not one per date and
    horizon, and a task holds one pair at a time.  Repeated rows add up, null values count for nothing.
    ``t_max`` cuts dates beyond the last shock.
    """
    keys = list(keys)

    def blocks(df: DataFrame, by: list, at: str, label: str, name: str) -> DataFrame:
        one = df.filter(F.col("value").isNotNull()).groupBy(*by, F.col(at).cast("long").alias(label)).agg(
            F.sum("value").cast("double").alias("v"))
        return one.groupBy(*by, F.floor(F.col(label) / block).alias(f"_{label}b")).agg(
            F.collect_list(F.struct(label, "v")).alias(name))    # at most ``block`` entries

    pairs = blocks(shocks, keys, t, "t", "_shocks").join(blocks(irf, [*keys, "variable"], "h", "h", "_path"), keys)
    out = [*keys, "variable"]
    kind = {f.name: f.dataType.simpleString() for f in pairs.schema}
    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in out), "_t long", "_v double"])
    reached = pairs.mapInArrow(_convolve(block, out, t_max), schema)
    return reached.groupBy(*out, F.col("_t").cast(shocks.schema[t].dataType).alias(t)).agg(F.sum("_v").alias("value"))


def half_life(rho: Column) -> Column:
    """Periods until half of a shock is left; null unless 0 < rho < 1."""
    return F.when((rho > 0) & (rho < 1), F.lit(math.log(0.5)) / F.ln(rho))


def ar1_irf(df: DataFrame, rho: str, sigma: str, horizon: int, name: str = "response") -> DataFrame:
    """Response of a log AR(1) process to one standard deviation, ``h = 0 .. horizon``."""
    out = df.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(horizon))))
    return out.withColumn(name, F.col(sigma) * F.pow(F.col(rho), F.col("h")))


__all__ = ["NON_SHOCKS", "ar1_irf", "component_total", "fevd", "group_contributions", "half_life", "shock_convolution"]

"""Shock contributions to the bars, lines and ticks of a historical decomposition, one lazy plan for any number of runs and variables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.labels import SHOCK_GROUPS
from panelspark.operators.series import axis_ticks, signed_stack
from panelspark.operators.shocks import component_total, group_contributions

STACK = ["pos_bottom", "pos_top", "neg_bottom", "neg_top"]
INITIAL_PART, TOTAL_PART = "initial", "total"


def historical_decomposition(contrib: DataFrame, dates: DataFrame, groups: list = SHOCK_GROUPS, keys: list = ("run", "variable"),
                             t: str = "t", every_years: int = 4) -> DataFrame:
    """(keys, t, date, tick, part, rank, value, positions): what is drawn at every date of every variable.

    ``contrib``: keys, t, component, value; ``dates``: t, date, one row per period.  A ``part`` is a shock group,
    stacked by rank away from zero, positives up and negatives down; ``initial``, a bar of its own from zero where the table has
    initial conditions; or ``total``, the line: shocks and initial conditions, without mean and constant.  Names of
    shocks may be decorated.  ``tick`` is the year at first quarters of every ``every_years``-th year and at a first date in January.
    """
    at = [*keys, t]
    bars = signed_stack(group_contributions(contrib, groups, at), at, "rank", "contribution").select(
        *at, F.col("group").alias("part"), "rank", F.col("contribution").alias("value"), *STACK)
    zero, nothing = F.lit(0.0), F.lit(None).cast("double")
    initial = F.col("initial")
    parts = F.array(
        F.struct(F.lit(INITIAL_PART).alias("part"), initial.alias("value"), *[c.alias(n) for n, c in zip(STACK, (
            zero, F.greatest(initial, zero), zero, F.least(initial, zero)))]),
        F.struct(F.lit(TOTAL_PART).alias("part"), F.col("total").alias("value"), *[nothing.alias(n) for n in STACK]))
    lines = component_total(contrib, at).select(*at, F.inline(parts)).filter(F.col("value").isNotNull())
    drawn = bars.unionByName(lines.withColumn("rank", F.lit(None).cast("int")))
    ticks = axis_ticks(dates.select(t, "date"), [], every_years=every_years).select(t, "tick")
    calendar = dates.select(t, "date").join(ticks, t, "left")
    return drawn.join(calendar, t, "left").select(*at, "date", "tick", "part", "rank", "value", *STACK)

"""Row numbers and running totals inside groups of any size.

They need an order within a group, and a plain window would pull the whole group
into one task.  Here a group is cut into ordered pieces; each piece is worked on
separately and the totals of the earlier pieces (a small table) are added.  Key
columns must not be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 20    # order values per piece


def _with_block(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / F.lit(width)).cast("long"))


def _earlier(keys: list) -> Window:
    return Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def number_rows(df: DataFrame, keys: list, order: str, name: str = "iter", width: int = BLOCK) -> DataFrame:
    """1-based position of each row within ``keys`` by a unique integer column."""
    cut = _with_block(df, order, width)
    sizes = cut.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select(
        *keys, "_block", F.coalesce(F.sum("_size").over(_earlier(keys)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    return (cut.join(before, [*keys, "_block"])
            .withColumn(name, (F.row_number().over(inside) + F.col("_before")).cast("long"))
            .drop("_block", "_before"))


def running_mean(df: DataFrame, keys: list, order: str, value: str, name: str = "running_mean",
                 width: int = BLOCK) -> DataFrame:
    """Mean of ``value`` over all rows of the group up to and including this one."""
    cut = _with_block(df, order, width)
    sums = cut.groupBy(*keys, "_block").agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    w = _earlier(keys)
    before = sums.select(
        *keys, "_block",
        F.coalesce(F.sum("_s").over(w), F.lit(0.0)).alias("_s0"),
        F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_n0"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("_s0") + F.coalesce(F.sum(value).over(inside), F.lit(0.0))
    count = F.col("_n0") + F.count(value).over(inside)
    return (cut.join(before, [*keys, "_block"])
            .withColumn(name, F.try_divide(total, count))
            .drop("_block", "_s0", "_n0"))

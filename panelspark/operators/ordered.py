"""Positions in a global order, without a window over all rows.

Rows are dealt by ranges of the order and sorted where they land.  A row's place
is its place inside its partition plus the rows of all partitions before it; the
partition totals, one row each, are the only thing that is added up in one spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import written

ROW_BITS = 33    # monotonically_increasing_id keeps the row of a partition in its lower 33 bits


def number_in_order(df: DataFrame, order: list[str | Column], name: str = "place") -> DataFrame:
    """Add ``name``: the 0-based position of each row in the order of ``order``.

    ``df`` is read twice, once to place the ranges: pass a stored or cheap table.
    Rows equal in all of ``order`` share a partition, so end it with columns that tell rows apart.
    """
    row, low = F.col("_row"), (1 << ROW_BITS) - 1
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order)
                     .withColumn("_row", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("_part", F.shiftright(row, ROW_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    # one row per partition of the order, whatever the rows
    return (placed.join(F.broadcast(starts), "_part")
            .withColumn(name, F.col("_start") + row.bitwiseAND(F.lit(low))).drop("_row", "_part", "_start"))

"""Contiguous shards of equal bytes from global prefix sums.

Rows are dealt by ranges of the id.  Each partition sums its sizes while it
passes over its sorted rows; the totals of all partitions, one row each, are
accumulated into the bytes before every partition.  A row's place on the global
byte line follows by addition, and the line is cut at equal targets.

Nothing but (id, size, checksum) is shuffled, once.  Repeated ids are allowed:
equal ids are ordered by checksum, size and input position, so one id that holds
many rows is still spread over partitions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import id_and_text
from panelspark.session import written

ROW_OVERHEAD = 8    # bytes that a stored row takes besides its text


def _running(batches):
    """Adds the bytes and rows of the same partition before each row."""
    import numpy as np
    used, seen = 0, 0
    for b in batches:
        size = b.column("size").to_numpy()
        after = used + np.cumsum(size)
        n = len(size)
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(after - size), pa.array(np.arange(seen, seen + n))],
            names=[*b.schema.names, "bytes_before", "rows_before"])
        if n:
            used, seen = int(after[-1]), seen + n


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, shard (0 to shards-1), slot (gapless from 0 in each shard).

    Shards are contiguous in the order (id, checksum, size, input position), null ids first.
    A row belongs to the shard in which its middle byte lies, so a shard differs
    from the target by half a row at either end.  Null and empty texts have the
    checksum of no bytes and size ``ROW_OVERHEAD``.  Shards may be empty where one
    row is longer than a target.  An empty table gives no rows.
    """
    utf8 = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = id_and_text(docs, id_col, text_col).select(
        "doc_id", (F.octet_length(utf8) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size", "place"]
    rows = (rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order)
            .sortWithinPartitions(*order).drop("place").withColumn("part", F.spark_partition_id()))
    placed = written(rows.mapInArrow(
        _running, "doc_id long, size long, text_crc32 long, part int, bytes_before long, rows_before long"), "sizes")

    # one row per partition: bytes and rows of all partitions before it
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    starts = totals.select("part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("part_bytes"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_rows"),
                           F.sum("b").over(Window.partitionBy()).alias("all_bytes"))
    middle = 2 * (F.col("part_bytes") + F.col("bytes_before")) + F.col("size")
    shard = F.least(F.lit(shards - 1), F.floor(middle / 2 / F.col("all_bytes") * shards)).cast("int")
    cut = placed.join(starts, "part").select(
        "doc_id", "size", "text_crc32", shard.alias("shard"),
        (F.col("part_rows") + F.col("rows_before")).alias("place"))
    first = cut.groupBy("shard").agg(F.min("place").alias("first"))    # one row per shard
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))

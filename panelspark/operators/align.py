"""Bring several period tables onto one calendar."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.session import written


def align(*dfs: DataFrame, on: list) -> DataFrame:
    """Inner join of all sources on key and date: only dates present in every source remain."""
    return reduce(lambda a, b: a.join(b, on, "inner"), dfs)


def common_periods(*dfs: DataFrame, on: list) -> DataFrame:
    """Distinct keys and dates found in all sources."""
    return reduce(lambda a, b: a.intersect(b), [d.select(*on) for d in dfs])


def first_match(df: DataFrame, keys: list, tiebreak: str | Column) -> DataFrame:
    """One row per key: the first in ``tiebreak`` order.

    A min-by aggregate instead of a row number: duplicates collapse before the
    shuffle, so a key with very many copies costs one row per input split.
    """
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(tiebreak) if isinstance(tiebreak, str) else tiebreak).alias("_first"))
    return kept.select(*keys, *[F.col("_first")[c].alias(c) for c in rest])


def _changed(rows: pa.Table, keys: list) -> np.ndarray:
    codes = [rows.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in keys]
    return np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in codes])])


def _nearest_years(keys: list, columns: list):
    """Known and next annual value of each dated row of a sorted partition, as far as the partition knows them.

    Two more rows per partition tell its neighbours about its first and last key: the first annual row of
    the one, the last of the other.
    """
    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        n, new = rows.num_rows, _changed(rows, keys)
        annual = ~rows.column("_dated").to_numpy()
        year, value = rows.column("_year").to_numpy(), rows.column("_value").to_numpy()
        at, segment = np.arange(n), np.cumsum(new) - 1
        start = np.flatnonzero(new)
        end = np.append(start[1:], n) - 1
        known = np.maximum.accumulate(np.where(annual, at, -1))
        after = np.append(np.minimum.accumulate(np.where(annual, at, n)[::-1])[::-1][1:], n)
        doubled = annual[1:] & annual[:-1] & ~new[1:] & (year[1:] == year[:-1])
        if doubled.any():
            raise ValueError(f"the annual table repeats the year {year[1:][doubled][0]} of a key")
        has_known, has_next = known >= start[segment], after <= end[segment]

        def table(pick, masks=(None, None), **more):
            out = rows.select(columns).take(pa.array(pick))
            for name, kind in _NEAREST:
                out = out.append_column(name, pa.array(more[name], kind, mask=dict(zip(("_v0", "_v1"), masks)).get(name)))
            return out

        part = TaskContext.get().partitionId()
        dated = np.flatnonzero(~annual)
        yield from table(
            dated, _part=np.full(len(dated), part), _v0=value[known[dated].clip(0)], _v1=value[after[dated].clip(0, n - 1)],
            _open=(~has_known[dated] & (segment[dated] == 0)) * 1 + (~has_next[dated] & (segment[dated] == len(start) - 1)) * 2,
            _end=np.zeros(len(dated), int), masks=(~has_known[dated], ~has_next[dated])).to_batches(max_chunksize=1 << 16)
        first, last = np.flatnonzero(annual[:end[0] + 1]), np.flatnonzero(annual[start[-1]:]) + start[-1]
        for flag, row, found in ((1, 0, first[:1]), (2, n - 1, last[-1:])):
            yield from table([row], _part=[part], _v0=[value[found[0]] if len(found) else None], _v1=[year[found[0]] if len(found) else None],
                             _open=[0], _end=[flag]).to_batches()
    return run


_NEAREST = (("_part", pa.int32()), ("_v0", pa.float64()), ("_v1", pa.float64()), ("_open", pa.int32()), ("_end", pa.int32()))


def _from_neighbours(ends: list, keys: list) -> list[tuple]:
    """Per partition: the last annual value before it of its first key, and the first after it of its last key."""
    ends = sorted(ends, key=lambda r: (r["_part"], r["_end"]))
    pairs = list(zip(ends[::2], ends[1::2]))

    def key(r):
        return tuple(r[k] for k in keys)

    def carried(firsts_and_lasts: list) -> list:
        """What reaches each partition in reading order from those before it: (value, year) or None."""
        out, held = [], None
        for near, far in firsts_and_lasts:
            mine = held[1:] if held and held[0] == key(near) else None
            out.append(mine)
            if far["_v0"] is not None:
                held = (key(far), far["_v0"], far["_v1"])
            elif not (held and held[0] == key(far)):
                held = None
        return out

    before = carried(pairs)
    beyond = carried([(b, a) for a, b in reversed(pairs)])[::-1]
    for (first, _), mine in zip(pairs, before):
        if mine and first["_v0"] is not None and mine[1] == first["_v1"]:
            raise ValueError(f"the annual table repeats the year {int(mine[1])} of a key")
    return [(first["_part"], b[0] if b else None, c[0] if c else None) for (first, _), b, c in zip(pairs, before, beyond)]


def asof_interpolate(df: DataFrame, annual: DataFrame, keys: list, date: str = "date", year: str = "year",
                     value: str = "value", name: str = "interpolated") -> DataFrame:
    """Annual values at quarterly dates by linear interpolation towards the next annual row.

    The quarter takes ``v0 (1-f) + v1 f`` with ``f = (quarter-1)/4``, where
    ``v0`` belongs to the last annual row at or before the year and ``v1`` to the
    row after it.  Before the first annual row the first value is used, at and
    after the last row the last value.  Null dates, and keys that are null or have no annual rows, get null; annual rows
    without year or value are left out, and a year that a key repeats is an error.

    Both sides are sorted together by ranges of (keys, year), so a key of any length spreads
    over tasks; a task looks to its neighbours through two rows per partition.
    """
    dated = df.withColumns({"_year": F.year(date), "_value": F.lit(None).cast("double"), "_dated": F.lit(True)})
    years = annual.filter(F.col(year).isNotNull() & F.col(value).isNotNull()).select(
        *keys, F.col(year).cast("int").alias("_year"), F.col(value).cast("double").alias("_value"), F.lit(False).alias("_dated"))
    usable = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.col("_year").isNotNull())
    both = dated.filter(usable).unionByName(years, allowMissingColumns=True)
    order = [*keys, "_year", "_dated"]    # a year's annual row before its quarters
    both = both.withColumn("_at", F.monotonically_increasing_id())
    together = both.repartitionByRange(*order, "_at").sortWithinPartitions(*order)
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_v0", T.DoubleType()),
                           T.StructField("_v1", T.DoubleType()), T.StructField("_open", T.IntegerType()), T.StructField("_end", T.IntegerType())])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    found = written(together.mapInArrow(_nearest_years(keys, df.columns), schema), "asof")
    ends = found.filter(F.col("_end") > 0).select(*keys, "_part", "_end", "_v0", "_v1").collect()    # two rows per partition
    near = df.sparkSession.createDataFrame(_from_neighbours(ends, keys), "_part int, _before double, _after double")
    out = found.filter(F.col("_end") == 0).join(F.broadcast(near), "_part")
    v0 = F.when(F.col("_open").bitwiseAND(1) > 0, F.col("_before")).otherwise(F.col("_v0"))
    v1 = F.when(F.col("_open").bitwiseAND(2) > 0, F.col("_after")).otherwise(F.col("_v1"))
    f = (F.quarter(date) - 1) / F.lit(4.0)
    out = out.withColumns({"_v0": v0, "_v1": v1}).withColumn(
        name, F.when(F.col("_v0").isNull(), F.col("_v1")).when(F.col("_v1").isNull(), F.col("_v0"))
        .otherwise(F.col("_v0") * (1 - f) + F.col("_v1") * f)).select(*df.columns, name)
    return out.unionByName(df.withColumn("_year", F.year(date)).filter(~usable).select(*df.columns, F.lit(None).cast("double").alias(name)))


def missing_keys(requested: DataFrame, available: DataFrame, on: list) -> DataFrame:
    """Requested names that the data do not have."""
    return requested.select(*on).distinct().join(available.select(*on).distinct(), on, "left_anti")

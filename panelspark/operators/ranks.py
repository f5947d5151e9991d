"""Exact ranks, quantiles and normal scores inside groups of any size, by one sample sort.

Rows are dealt by ranges of (group, value) and sorted where they land, so a large
group spreads over many tasks, and so does a value that fills half a group: the
rest of the row orders it further.  A task turns equal rows into one counted row and
numbers its rows; a summary of each partition (rows, first and last group and value) then tells every
task how many rows lie before it and how far a run of equal values or a group
reaches into its neighbours.  The summary has one row per partition, whatever the data.

There is no second path for small groups, and the draws are shuffled once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.numeric import with_norm_ppf
from panelspark.session import written

ROWS_PER_TASK = 1 << 21    # rows a task sorts and holds; sets the number of ranges of large inputs
# bits of a row: its run of equal values, or its group, reaches an end of the partition; it is the first or last row there
_RUN_FIRST, _RUN_LAST, _GROUP_FIRST, _GROUP_LAST, _ROW_FIRST, _ROW_LAST = 1, 2, 4, 8, 16, 32


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """True where a sorted column differs from the row before; nulls and NaN equal themselves."""
    code = column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.concatenate([[True], code[1:] != code[:-1]])


def _bounds(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row of the run that each row lies in."""
    first = np.flatnonzero(starts)
    run = np.cumsum(starts) - 1
    return first[run], np.append(first[1:], len(starts))[run] - 1


def _number(keys: list, value: str, carry: list, counts: list):
    """Counted rows of one sorted partition with the counts before and up to their value and group."""
    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        group = np.logical_or.reduce([_changes(rows.column(c)) for c in keys])
        same_value = group | _changes(rows.column(value))
        cell = np.logical_or.reduce([same_value, *(_changes(rows.column(c)) for c in carry)])
        (v0, v1), (g0, g1), last = _bounds(same_value), _bounds(group), len(cell) - 1
        at = np.flatnonzero(cell)
        edge = (_RUN_FIRST * (v0 == 0) | _RUN_LAST * (v1 == last) | _GROUP_FIRST * (g0 == 0) | _GROUP_LAST * (g1 == last))
        edge[0] |= _ROW_FIRST
        edge[at[-1]] |= _ROW_LAST
        out = rows.select([*keys, value, *carry]).take(pa.array(at))
        for name in counts:
            n = rows.column(name).to_numpy()
            upto = np.cumsum(n)
            before = upto - n
            for suffix, c in (("", np.add.reduceat(n, at)), ("_v0", before[v0][at]), ("_v1", upto[v1][at]),
                              ("_g0", before[g0][at]), ("_g1", upto[g1][at]), ("_rows", np.full(len(at), upto[-1]))):
                out = out.append_column(name + suffix, pa.array(c, pa.int64()))
        out = out.append_column("_edge", pa.array(edge[at], pa.int32()))
        out = out.append_column("_part", pa.array(np.full(len(at), TaskContext.get().partitionId()), pa.int32()))
        yield from out.to_batches(max_chunksize=1 << 16)
    return run


_EXTENTS = [(kind, bit, row) for kind, first, last in (("v", _RUN_FIRST, _RUN_LAST), ("g", _GROUP_FIRST, _GROUP_LAST))
            for bit, row in ((first, _ROW_FIRST), (last, _ROW_LAST))]


def _places(summary: list, keys: list, value: str, counts: list) -> tuple[np.ndarray, dict]:
    """Partitions in order, and per count the rows before each and the whole extents of the runs and groups at its ends."""
    parts = sorted({r["_part"] for r in summary})
    rows = {(r["_part"], bit): r for r in summary for bit in (_ROW_FIRST, _ROW_LAST) if r["_edge"] & bit}
    places: dict = {}
    for name in counts:
        starts, start, extent = [], 0, {}
        ends: dict = {bit: [] for _, bit, _ in _EXTENTS}
        for part in parts:
            for kind, bit, which in _EXTENTS:
                r = rows[part, which]
                who = (kind, *(r[k] for k in keys), *([repr(r[value])] if kind == "v" else []))
                low, high = start + r[f"{name}_{kind}0"], start + r[f"{name}_{kind}1"]
                known = extent.setdefault(who, [low, high])
                known[0], known[1] = min(known[0], low), max(known[1], high)
                ends[bit].append(known)    # shared, so it ends as the whole extent
            starts.append(start)
            start += rows[part, _ROW_FIRST][f"{name}_rows"]
        places[name] = np.array(starts, np.int64), {bit: np.array(found, np.int64) for bit, found in ends.items()}
    return np.array(parts), places


def _resolve(keep: list, parts: np.ndarray, places: dict):
    """Places in the whole group from places in a partition."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            at, edge = np.searchsorted(parts, b.column("_part").to_numpy()), b.column("_edge").to_numpy()
            columns, names = [b.column(c) for c in keep], list(keep)
            for name, (starts, ends) in places.items():
                found = {c: starts[at] + b.column(f"{name}_{c}").to_numpy() for c in ("v0", "v1", "g0", "g1")}
                for kind, bit, _ in _EXTENTS:
                    here = np.flatnonzero(edge & bit)
                    for i in (0, 1):
                        found[f"{kind}{i}"][here] = ends[bit][at[here], i]
                columns += [b.column(name), *(pa.array(found[c] - found["g0"]) for c in ("v0", "v1", "g1"))]
                names += [name, f"{name}_before", f"{name}_upto", f"{name}_all"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def ranked(df: DataFrame, keys: list, value: str, carry: list = (), counts: dict[str, Column] | None = None) -> DataFrame:
    """Rows of ``df`` counted by (keys, value, carry), with their place in the group's order.

    For each entry of ``counts`` (default: ``n``, one per row): the count ``n``, ``n_before`` and ``n_upto`` with
    smaller, and with smaller or equal, values in the group, and ``n_all`` in the group.  Null values are left out.
    ``df`` is read three times (its size, the ranges, the sort): pass a stored or cheap table.
    """
    carry, counts = list(carry), counts or {"n": F.lit(1)}
    names = list(counts)
    signless = F.when(F.col(value) == 0, F.lit(0)).otherwise(F.col(value)).cast(df.schema[value].dataType)    # -0.0 ties with 0.0
    rows = (df.filter(F.col(value).isNotNull())
            .select(*keys, signless.alias(value), *carry, *[c.cast("long").alias(n) for n, c in counts.items()]))
    order = [*keys, value, *carry, "_at"]    # the place of a row tells equal rows apart, so they need not share a task
    size, default = df.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = math.ceil(size / ROWS_PER_TASK)
    dealt = rows.withColumn("_at", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(ranges, *order) if ranges > default else dealt.repartitionByRange(*order)
    longs = [n + s for n in names for s in ("", "_v0", "_v1", "_g0", "_g1", "_rows")]
    schema = T.StructType([*[rows.schema[c] for c in (*keys, value, *carry)], *[T.StructField(c, T.LongType()) for c in longs],
                           T.StructField("_edge", T.IntegerType()), T.StructField("_part", T.IntegerType())])
    sorted_rows = written(dealt.sortWithinPartitions(*order).drop("_at").mapInArrow(_number(keys, value, carry, names), schema), "ranked")

    # at most two rows per partition, as for the ranges of a sort
    summary = sorted_rows.filter(F.col("_edge") >= _ROW_FIRST).collect()
    parts, places = _places(summary, keys, value, names)
    keep = [*keys, value, *carry]
    schema = T.StructType([*[rows.schema[c] for c in keep], *[
        T.StructField(n + s, T.LongType()) for n in names for s in ("", "_before", "_upto", "_all")]])
    return sorted_rows.mapInArrow(_resolve(keep, parts, places), schema)


def _pick(keys: list, value: str, probs: list, count: str):
    """Rows that hold the lower or upper neighbour of a quantile, with its weight."""
    def run(batches):
        for b in batches:
            before, upto, n = (b.column(f"{count}_{c}").to_numpy() for c in ("before", "upto", "all"))
            for i, p in enumerate(probs):
                pos = (n - 1) * p
                low = np.floor(pos)
                for side, (rank, weight) in enumerate(((low, 1 - (pos - low)), (np.ceil(pos), pos - low))):
                    here = pa.array(np.flatnonzero((rank >= before) & (rank < upto)))
                    if len(here):
                        yield pa.RecordBatch.from_arrays(
                            [*(b.column(k).take(here) for k in keys), b.column(value).cast(pa.float64()).take(here),
                             pa.array(weight).take(here), pa.array([2 * i + side] * len(here), pa.int32())],
                            names=[*keys, "_v", "_w", "_i"])
    return run


def quantiles_of(rows: DataFrame, keys: list, value: str, probs: dict, count: str = "n") -> DataFrame:
    """Quantiles with linear interpolation from a result of ``ranked``; ``probs`` maps output name to probability."""
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("_v", T.DoubleType()), T.StructField("_w", T.DoubleType()),
                           T.StructField("_i", T.IntegerType())])
    picked = rows.mapInArrow(_pick(keys, value, [float(p) for p in probs.values()], count), schema)
    # a neighbour may come in several rows of the same value: two per quantile and group are left
    ends = picked.groupBy(*keys, "_i").agg(F.max("_v").alias("_v"), F.max("_w").alias("_w"))
    part = F.col("_v") * F.col("_w")
    return ends.groupBy(*keys).agg(*[
        F.sum(F.when(F.floor(F.col("_i") / 2) == i, part)).alias(n) for i, n in enumerate(probs)])


def exact_quantiles(df: DataFrame, keys: list, value: str, probs: dict) -> DataFrame:
    """Exact quantiles with linear interpolation; ``probs`` maps output name to probability."""
    return quantiles_of(ranked(df, keys, value), keys, value, probs)


def with_scores(rows: DataFrame, count: str = "n") -> DataFrame:
    """Add the average ``rank`` and its normal score ``z``, the inverse normal of (rank - 3/8)/(n + 1/4)."""
    rows = rows.withColumn("rank", (F.col(f"{count}_before") + F.col(f"{count}_upto") + 1) / 2)
    return with_norm_ppf(rows, (F.col("rank") - 0.375) / (F.col(f"{count}_all") + 0.25), "z")

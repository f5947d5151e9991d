"""Mix sources to target weights, in whole documents, by subset sums over length counts.

Each source gets a budget of words.  Whole repeats of the source come off first; what
remains is a subset-sum problem over its documents.  Documents of equal length are
interchangeable there, so only counts by exact length enter: long before short, every
length takes the share of its documents that keeps the running total on the budget's line, and a
bounded-knapsack dynamic program over the last ``RESERVE`` words of the budget picks how many more of each length
to take so that nothing, or as little as possible, is left.  Which documents of a length are taken is
decided by a seeded order of their ids.

Shuffled are ids, sizes and lengths, never texts.  A source is one row of its length
counts per distinct length; the seeded order is a range partitioning over (source, length, hash), so neither a hot
source nor a hot length lands in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.ordered import number_in_order
from panelspark.session import written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE_PERCENT = 150
REPEATS = 2
SEED = 11
RESERVE = 1 << 16       # words of a budget left to the dynamic program
ASIDE = 8               # documents of a length kept for it
WIDEST = 1 << 22        # the widest remaining budget it takes at once
SOURCE = ["_unnamed", "_source"]    # null sources apart from the source of empty name, and last


def subset_sum(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that their sum is the largest reachable up to ``budget``."""
    taken = [0] * len(lengths)
    if budget <= 0:
        return taken
    by = np.full(budget + 1, -1, np.int32)    # the first length with which a sum was reached
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    for i, (length, count) in enumerate(zip(lengths, counts)):
        left, step = min(count, budget // length), 1
        if not left:
            continue
        before = reached.copy()
        while left and not reached[budget]:    # 1, 2, 4, ... and the rest of the copies
            step = min(step, left)
            move = step * length
            reached[move:] |= reached[:budget + 1 - move].copy()
            left, step = left - step, 2 * step
        by[reached & ~before] = i
        if reached[budget]:
            break
    at = int(np.nonzero(reached)[0][-1])
    # back from the sum: a length is used as long as it was the first to reach what is left, at most ``count`` times
    while at:
        taken[by[at]] += 1
        at -= lengths[by[at]]
    return taken


def fit_budget(lengths: list[int], counts: list[int], budget: int, reserve: int = RESERVE, widest: int = WIDEST) -> list[int]:
    """How many documents of each (distinct, positive) length sum up to ``budget`` or closely below."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    aside, room = [0] * len(lengths), reserve
    for i in reversed(order):    # a few documents of each short length, so the dynamic program can choose
        aside[i] = min(counts[i], ASIDE, room // lengths[i])
        room -= aside[i] * lengths[i]
    free = [c - a for c, a in zip(counts, aside)]
    whole, taken, used, seen = sum(n * c for n, c in zip(lengths, free)), [0] * len(lengths), 0, 0
    even = max(0, budget - reserve)
    for i in order:
        seen += lengths[i] * free[i]
        taken[i] = min(free[i], (even * seen // max(whole, 1) - used) // lengths[i])
        used += taken[i] * lengths[i]
    for kept in (reserve, 0):    # only where documents are longer than the dynamic program is wide
        for i in order:
            if budget - used > widest:
                more = min(counts[i] - taken[i], max(0, budget - used - kept) // lengths[i])
                taken[i], used = taken[i] + more, used + more * lengths[i]
    rest = [i for i in order if taken[i] < counts[i] and lengths[i] <= budget - used]
    if budget - used <= widest:
        for i, more in zip(rest, subset_sum([lengths[i] for i in rest], [counts[i] - taken[i] for i in rest], budget - used)):
            taken[i] += more
    return taken


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share_percent: int = SHARE_PERCENT,
                   repeats: int = REPEATS) -> DataFrame:
    """(source keys, source_size, target): one row per source.

    Every source below its limit of ``repeats`` times its size gets the same number of words per weight.
    In the order of limit over weight the sources at their limit come first, so this level is the first
    that the remaining budget and weights give without passing the next source's limit.
    """
    table = sizes.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    # windows over one row per source
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    at = (F.row_number().over(Window.orderBy(*SOURCE)) - 1) % len(weights)
    table = table.withColumn("_weight", F.get(cycle, at)).withColumn("_limit", (repeats * F.col("source_size")).cast("double"))
    ratio = F.col("_limit") / F.col("_weight")
    by_ratio = Window.orderBy(ratio, *SOURCE)
    earlier, later, everything = (by_ratio.rowsBetween(a, b) for a, b in (
        (Window.unboundedPreceding, -1), (Window.currentRow, Window.unboundedFollowing),
        (Window.unboundedPreceding, Window.unboundedFollowing)))
    budget = F.sum("source_size").over(everything) * share_percent / 100
    level = (budget - F.coalesce(F.sum("_limit").over(earlier), F.lit(0.0))) / F.sum("_weight").over(later)
    table = table.withColumns({"_level": level, "_ratio": ratio, "_rank": F.row_number().over(by_ratio)})
    table = table.withColumn("_final", F.min_by(F.col("_level"), F.when(F.col("_ratio") >= F.col("_level"), F.col("_rank"))).over(everything))
    target = F.least("_limit", F.coalesce(F.col("_final"), F.lit(float("inf"))) * F.col("_weight"))
    return table.select(*SOURCE, "source_size", target.alias("target"))


def _allot(table):
    """The counts of one source by length, with whole repeats and extra documents of each."""
    lengths, counts = table.column("size").to_pylist(), table.column("n").to_pylist()
    whole, target = table.column("source_size")[0].as_py(), table.column("target")[0].as_py()
    budget = round(target)
    repeats = budget // whole if whole else 0
    some = [i for i, n in enumerate(lengths) if n > 0]
    extra = [0] * len(lengths)
    for i, n in zip(some, fit_budget([lengths[i] for i in some], [counts[i] for i in some], budget - repeats * whole)):
        extra[i] = n
    return (table.append_column("repeats", pa.array([repeats] * len(lengths), pa.int64()))
            .append_column("extra", pa.array(extra, pa.int64())).drop_columns(["n"]))


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, share_percent: int = SHARE_PERCENT, repeats: int = REPEATS,
                seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: (doc_id, size, source_size, target, taken).

    Sources weigh ``weights`` in code-point order, null last, over and over, and share ``share_percent`` % of all words, at
    most ``repeats`` times their size each.  ``taken`` is the document's size times how often the mix holds it, 0 to
    ``repeats`` times.  The words taken of a source are its target, rounded, wherever a subset of its documents has
    that sum; they never exceed it.

    Null and empty texts have size 0 and nothing to take.  Of repeated rows some may be taken and others not, counted
    right.  Very long texts count whole; a source whose documents are all longer than ``WIDEST`` words is filled longest
    first.  An empty table gives no rows.  Other columns are never read.  Reruns agree: the choice depends on seed and id.
    """
    words = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    rows = written(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), words.cast("long").alias("size"),
        F.col(source_col).isNull().alias("_unnamed"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source")), "sizes")
    group = [*SOURCE, "size"]
    placed = number_in_order(rows.withColumn("_luck", F.xxhash64(F.lit(seed), "doc_id")).withColumn("_at", F.monotonically_increasing_id()),
                             [*group, "_luck", "doc_id", "_at"])
    by_length = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    by_length = written(by_length, "lengths")
    targets = source_targets(rows, weights, share_percent, repeats)
    plan = by_length.join(targets, SOURCE).groupBy(*SOURCE).applyInArrow(
        _allot, "_unnamed boolean, _source string, size long, first long, source_size long, target double, repeats long, extra long")
    # one row per source and length: broadcast only if the written table is small
    chosen = placed.join(written(plan, "allotted"), group)
    copies = F.col("repeats") + (F.col("place") - F.col("first") < F.col("extra")).cast("long")
    return chosen.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))

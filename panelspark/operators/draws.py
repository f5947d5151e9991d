"""Summaries of sampler draws ``(run, param, chain, iter, value)``.

Iterations of a chain are distinct integers; gaps, as in thinned chains, are allowed.
A parameter may hold any share of the rows: every step in value order is a sample sort
(``ranks``), every step along a chain works on blocks of it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.operators import ranks, split
from panelspark.session import written

KEYS = ["run", "param"]
QUANTILES = {"q025": 0.025, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q975": 0.975}
_TAILS = {"_q05": 0.05, "_q95": 0.95}
FIRST_LAGS = 256     # lags of the first round of autocovariances
LAG_GROWTH = 8       # each further round reaches so many times as far
CHAIN_BLOCK = 65536  # draws per Arrow group when autocovariances are summed
_PARTS = 1024        # pieces an iteration range is cut into when a chain is halved


def posterior_summary(draws: DataFrame, keys: list = KEYS) -> DataFrame:
    """Mean, standard deviation (n-1) and count over all chains."""
    return draws.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n"))


def posterior_quantiles(draws: DataFrame, keys: list = KEYS, probs: dict = QUANTILES) -> DataFrame:
    """2.5, 25, 50, 75 and 97.5 % quantiles, linearly interpolated."""
    return ranks.exact_quantiles(draws, keys, "value", probs)


def _smallest_iterations(draws: DataFrame, targets: DataFrame) -> DataFrame:
    """(run, param, chain, name, iter): the ``k``-th smallest iteration of a chain for rows (.., name, k, low, width).

    The range [low, low + width) of a target is cut into at most 1024 parts, the draws are counted by part, and the search goes on
    in the part that holds the target, until a part has no gaps.  A chain without gaps needs no pass at all;
    nothing but counts is shuffled.
    """
    chain = [*KEYS, "chain"]
    done, state = [], written(targets, "targets")
    while True:
        full = (F.col("n") == F.col("width")) | (F.col("width") == 1)
        done.append(state.filter(full).select(*chain, "name", (F.col("low") + F.col("k") - 1).alias("iter")))
        state = state.filter(~full)
        if state.isEmpty():
            return reduce(DataFrame.union, done)
        step = F.ceil(F.col("width") / _PARTS).cast("long")
        counted = (draws.join(state.select(*chain, "name", "k", "low", "width"), chain)
                   .filter((F.col("iter") >= F.col("low")) & (F.col("iter") < F.col("low") + F.col("width")))
                   .withColumn("_step", step).withColumn("_at", F.floor((F.col("iter") - F.col("low")) / F.col("_step")))
                   .groupBy(*chain, "name", "k", "low", "width", "_step", "_at").agg(F.count(F.lit(1)).alias("n")))
        upto = Window.partitionBy(*chain, "name").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)    # at most 1024 rows
        counted = counted.withColumn("_upto", F.sum("n").over(upto))
        state = written(counted.filter((F.col("_upto") >= F.col("k")) & (F.col("_upto") - F.col("n") < F.col("k"))).select(
            *chain, "name", (F.col("k") - F.col("_upto") + F.col("n")).alias("k"), (F.col("low") + F.col("_at") * F.col("_step")).alias("low"),
            F.least("_step", F.col("width") - F.col("_at") * F.col("_step")).alias("width"), "n"), "targets")


def with_half(draws: DataFrame) -> DataFrame:
    """Add ``half`` (0, 1, or null for the middle draw of an odd chain) from the iterations where each chain is cut.

    The draws themselves are not shuffled: the cuts are one row per chain.
    """
    chain = [*KEYS, "chain"]
    kept = draws.filter(F.col("value").isNotNull())
    chains = kept.groupBy(*chain).agg(
        F.count(F.lit(1)).alias("n"), F.min("iter").cast("long").alias("low"), F.max("iter").cast("long").alias("_last"))
    half = F.floor(F.col("n") / 2).cast("long")
    targets = chains.filter("n > 1").select(
        *chain, F.inline(F.array(F.struct(F.lit("end").alias("name"), half.alias("k")),
                                 F.struct(F.lit("begin").alias("name"), (F.col("n") - half + 1).alias("k")))),
        "low", (F.col("_last") - F.col("low") + 1).alias("width"), "n")
    cuts = _smallest_iterations(kept, targets).groupBy(*chain).agg(
        *[F.max(F.when(F.col("name") == n, F.col("iter"))).alias(f"_{n}") for n in ("end", "begin")])
    half = F.when(F.col("iter") <= F.col("_end"), 0).when(F.col("iter") >= F.col("_begin"), 1)
    return kept.join(written(cuts, "cuts"), chain, "left").withColumn("half", half).drop("_end", "_begin")


def split_halves(draws: DataFrame) -> DataFrame:
    """Add ``half`` (0 or 1), ``pos`` within the half and its length ``n_half``; an odd middle draw is dropped.

    Positions follow the order of the iterations, whatever their numbers; null draws are left out.
    """
    return _numbered(draws).filter(F.col("half").isNotNull())


def _numbered(draws: DataFrame) -> DataFrame:
    keys = [*KEYS, "chain"]
    numbered = split.number_rows(draws.filter(F.col("value").isNotNull()), keys, "iter", "_seq")
    chains = written(draws.groupBy(*keys).agg(F.count("value").alias("_len")), "chains")
    length = F.col("_len")
    n_half = F.floor(length / 2).cast("long")
    at = F.col("_seq") - 1
    half = F.when(at < n_half, 0).when(at >= length - n_half, 1)
    out = numbered.join(chains, keys).withColumns({"n_half": n_half, "half": half, "_at": at})
    pos = F.when(F.col("half") == 0, F.col("_at")).otherwise(F.col("_at") - (length - F.col("n_half")))
    return out.withColumn("pos", pos).drop("_len", "_seq", "_at")


@dataclass
class Prepared:
    """What several diagnostics of the same draws share: one sort of the draws by value."""

    ranked: DataFrame       # counted draws with ``half``, their places among all draws (n) and among those in a half (kept)
    quantiles: DataFrame    # exact quantiles per run and parameter, written


def prepare(draws: DataFrame, along: bool = False) -> Prepared:
    """Sort the draws by value; ``along`` keeps every draw and its position in the chain, for autocovariances."""
    carry = ["chain", "half", *(["n_half", "pos"] if along else [])]
    halved = written(_numbered(draws), "numbered") if along else with_half(draws)
    ranked = ranks.ranked(halved, KEYS, "value", carry, {"n": F.lit(1), "kept": F.col("half").isNotNull()})
    return Prepared(ranked, written(ranks.quantiles_of(ranked, KEYS, "value", {**QUANTILES, **_TAILS}), "quantiles"))


def _rhat(moments: DataFrame, name: str) -> DataFrame:
    """Potential scale reduction from ``n, mean, var`` per half chain."""
    agg = moments.groupBy(*KEYS).agg(
        F.avg("var").alias("_w"), F.var_samp("mean").alias("_b"), F.avg("n").alias("_n"))
    ratio = F.try_divide((F.col("_n") - 1) / F.col("_n") * F.col("_w") + F.col("_b"), F.col("_w"))
    return agg.select(*KEYS, F.sqrt(ratio).alias(name))


def rhat_split(draws: DataFrame) -> DataFrame:
    """R-hat over chains split in two; accept below 1.05."""
    moments = with_half(draws).filter(F.col("half").isNotNull()).groupBy(*KEYS, "chain", "half").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
    return _rhat(moments, "rhat")


def _score_moments(scores: DataFrame, count: str) -> DataFrame:
    agg = scores.groupBy(*KEYS, "chain", "half").agg(
        F.sum(count).alias("n"),
        F.sum(F.col(count) * F.col("z")).alias("_s1"),
        F.sum(F.col(count) * F.col("z") * F.col("z")).alias("_s2"))
    var = F.try_divide(F.col("_s2") - F.col("_s1") * F.col("_s1") / F.col("n"), F.col("n") - 1)
    return agg.select(*KEYS, "chain", "half", "n", (F.col("_s1") / F.col("n")).alias("mean"), var.alias("var"))


def rhat_rank(draws: DataFrame, prepared: Prepared | None = None) -> DataFrame:
    """Rank-normalised R-hat: bulk, folded around the median (tail), and the larger of the two.

    Two sorts in all: the draws by value, and the counted distances to the median.
    """
    prepared = prepared or prepare(draws)
    halves = prepared.ranked.filter(F.col("half").isNotNull())
    median = prepared.quantiles.select(*KEYS, F.col("q50").alias("_median"))
    folded = halves.join(median, KEYS).select(
        *KEYS, "chain", "half", F.abs(F.col("value") - F.col("_median")).alias("value"), "kept")
    tails = ranks.ranked(folded, KEYS, "value", ["chain", "half"], {"kept": F.col("kept")})
    bulk = _rhat(_score_moments(ranks.with_scores(halves, "kept"), "kept"), "rhat_bulk")
    tail = _rhat(_score_moments(ranks.with_scores(tails, "kept"), "kept"), "rhat_tail")
    return bulk.join(tail, KEYS).withColumn("rhat", F.greatest("rhat_bulk", "rhat_tail"))


_SIGNALS = ("bulk", "low", "high")
_SUMS = ("products", "first", "last", "total")


def signals_of(prepared: Prepared) -> DataFrame:
    """The three signals of the sample-size estimates along each half chain, written.

    ``bulk`` is the normal score of the draw, ``low`` and ``high`` flag draws at
    or below the 5 % and 95 % quantile.
    """
    ends = prepared.quantiles.select(*KEYS, *_TAILS)
    scored = ranks.with_scores(prepared.ranked.filter(F.col("half").isNotNull()), "kept").join(ends, KEYS)
    flags = [(F.col("value") <= F.col(q)).cast("double").alias(s) for q, s in (("_q05", "low"), ("_q95", "high"))]
    return written(scored.select(*KEYS, "chain", "half", "n_half", "pos", F.col("z").alias("bulk"), *flags), "signals")


def _lag_sums(keys: list, block: int, width: int):
    """Per block of one half chain and window of lags: lagged products, and the sums before and after each lag.

    The block's draws meet the ``block + width - 1`` draws that begin ``lag`` later; one
    circular correlation of that length holds all lags of the window without wrapping (overlap-save).
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        pos, n_half = pdf["pos"].to_numpy(), int(pdf["n_half"].iloc[0])
        start, lag = int(pdf["_block"].iloc[0]) * block, int(pdf["_lag"].iloc[0])
        own = slice(*np.searchsorted(pos, [start, start + block]))
        met = slice(*np.searchsorted(pos, [start + lag, start + lag + block + width - 1]))
        lags = np.arange(lag, min(lag + width, n_half))
        frames = []
        for signal in _SIGNALS:
            x = pdf[signal].to_numpy(dtype=float)
            mine, other = x[own], x[met]
            size = 1 << max(1, int(max(len(mine), len(other)) + len(lags)).bit_length())
            both = np.fft.irfft(np.conj(np.fft.rfft(mine, size)) * np.fft.rfft(other, size), size)
            cum = np.concatenate([[0.0], np.cumsum(mine)])
            frames.append(pd.DataFrame({
                "signal": signal, "lag": lags, "products": both[:len(lags)],
                # sums over pos < lag and over pos >= n_half - lag
                "first": cum[np.searchsorted(pos[own], lags)],
                "last": cum[-1] - cum[np.searchsorted(pos[own], n_half - lags)],
                "total": cum[-1]}))
        out = pd.concat(frames, ignore_index=True)
        for c in keys:
            out[c] = pdf[c].iloc[0]
        out["n_half"] = n_half
        return out
    return run


def autocovariance(signals: DataFrame, first: int = 0, last: int = FIRST_LAGS, block: int = CHAIN_BLOCK) -> DataFrame:
    """Autocovariances of each split half chain for the lags ``first`` to ``last - 1``.

    A half chain is cut into blocks of ``block`` draws and the lags into windows of at most as
    many; a block also gets the draws that its window of lags reaches, so the sums over lagged pairs
    add up exactly, a task holds at most three blocks, and every draw is sent a bounded number of times per window.
    """
    width = min(block, last - first)
    chain = [*KEYS, "chain", "half"]
    own = F.floor(F.col("pos") / block).cast("long")
    late = F.col("pos") - F.col("_lag")
    low = F.greatest(F.floor((late - (width - 1)) / block), F.lit(0)).cast("long")
    high = F.floor(late / block).cast("long")
    blocks = F.when(late < 0, F.array(own)).otherwise(F.array_union(F.array(own), F.sequence(low, high)))
    windows = F.array(*[F.lit(w).cast("long") for w in range(first, last, width)])
    rows = (signals.filter(F.col("n_half") > first).withColumn("_lag", F.explode(windows)).filter(F.col("_lag") < F.col("n_half"))
            .withColumn("_block", F.explode(blocks)))
    schema = T.StructType([
        T.StructField("signal", T.StringType()), T.StructField("lag", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in _SUMS],
        *[signals.schema[c] for c in chain], T.StructField("n_half", T.LongType())])
    sums = (rows.groupBy(*chain, "_lag", "_block").applyInPandas(_lag_sums(chain, block, width), schema)
            .filter(F.col("lag") < last).groupBy(*chain, "n_half", "signal", "lag").agg(*[F.sum(c).alias(c) for c in _SUMS]))
    n = F.col("n_half").cast("double")
    mean = F.col("total") / n
    pairs = F.col("products") - mean * (2 * F.col("total") - F.col("first") - F.col("last")) \
        + (n - F.col("lag")) * mean * mean
    return sums.select(*chain, "n_half", "signal", "lag", mean.alias("mean"), (pairs / n).alias("acov"))


def _pair_sums(acov: DataFrame, max_lag: int | None) -> DataFrame:
    """Autocorrelations over all split chains added in pairs of lags, and whether the pairs so far are positive."""
    lags = acov.groupBy(*KEYS, "signal", "lag").agg(
        F.avg("acov").alias("acov"), F.var_samp("mean").alias("_b"),
        F.avg("n_half").alias("_n"), F.min("n_half").alias("_n_min"), F.sum("n_half").alias("_draws"),
        F.avg(F.col("acov") * F.col("n_half") / F.greatest(F.col("n_half") - 1, F.lit(1))).alias("_w"))
    whole = Window.partitionBy(*KEYS, "signal")

    def at_zero(c: str) -> Column:
        return F.max(F.when(F.col("lag") == 0, F.col(c))).over(whole)

    # every half chain contributes to lag 0, so its row describes the group
    lags = lags.withColumns({f"{c}0": at_zero(c) for c in ("_w", "_b", "_n", "_n_min", "_draws")})
    top = F.col("_n_min0") - 4
    top = top if max_lag is None else F.least(F.lit(max_lag), top)
    var_plus = (F.col("_n0") - 1) / F.col("_n0") * F.col("_w0") + F.coalesce(F.col("_b0"), F.lit(0.0))
    rho = F.when(F.col("lag") == 0, 1.0).otherwise(1 - F.try_divide(F.col("_w0") - F.col("acov"), var_plus))
    pairs = (lags.withColumn("_top", top).withColumn("_rho", rho)
             .withColumn("_pair", F.floor(F.col("lag") / 2))
             .filter((F.col("_pair") * 2 < F.col("_top")))
             .groupBy(*KEYS, "signal", "_pair", "_draws0", "_w0", "_top")
             .agg(F.sum("_rho").alias("_p"), F.max(F.when(F.col("lag") % 2 == 0, F.col("_rho"))).alias("_even")))
    run = Window.partitionBy(*KEYS, "signal").orderBy("_pair").rowsBetween(Window.unboundedPreceding, 0)
    positive = F.min(F.when(F.col("_pair") == 0, 1.0).otherwise(F.col("_p"))).over(run) > 0
    return pairs.withColumns({"_alive": positive, "_mono": F.min("_p").over(run)})


def effective_sample_size(draws: DataFrame, max_lag: int | None = None, block: int = CHAIN_BLOCK,
                          first_lags: int = FIRST_LAGS, prepared: Prepared | None = None) -> DataFrame:
    """``ess_bulk`` and ``ess_tail`` (the smaller of the 5 % and 95 % flags), and ``lag_limited``.

    Autocorrelations over all split chains are added in pairs while the pairs stay positive, forced to be
    non-increasing.  Lags are extended, for the parameters that need it, until a pair is not
    positive; ``lag_limited`` tells that none was up to ``max_lag`` or, by default, the length of the half
    chains, so the estimate is too high.  Rounds reach 256, 2 048, 16 384, ... lags: their number grows with the logarithm
    of the longest memory of any chain.
    """
    if first_lags % 2:
        raise ValueError("first_lags must be even, so that no pair of lags is split between rounds")
    signals = signals_of(prepared or prepare(draws, along=True))
    done, first, last, left = [], 0, first_lags, signals
    while True:
        done.append(written(autocovariance(left, first, last, block), "acov"))
        pairs = _pair_sums(reduce(DataFrame.union, done), max_lag)
        ends = pairs.groupBy(*KEYS, "signal").agg(F.min("_alive").alias("_alive"), F.max("_top").alias("_top"))
        further = written(ends.filter(F.col("_alive") & (F.col("_top") > last)).select(*KEYS).distinct(), "further")
        if further.isEmpty():
            return _ess_from(pairs)
        left, first, last = signals.join(further, KEYS, "left_semi"), last, last * LAG_GROWTH


def _ess_from(pairs: DataFrame) -> DataFrame:
    agg = pairs.groupBy(*KEYS, "signal", "_draws0", "_w0").agg(
        F.sum(F.when(F.col("_alive"), F.col("_mono"))).alias("_sum"), F.min("_alive").alias("_alive"),
        F.coalesce(F.min_by("_even", F.when(~F.col("_alive"), F.col("_pair"))), F.max_by("_even", "_pair")).alias("_even"))
    tau = F.greatest(F.lit(0.0), 2 * F.col("_sum") + F.greatest(F.lit(0.0), F.col("_even")) - 1)
    draws_n = F.col("_draws0").cast("double")
    ess = F.when(F.col("_w0") > 0, F.least(F.coalesce(F.try_divide(F.lit(1.0), tau), F.log10(draws_n)),
                                           F.log10(draws_n)) * draws_n)
    by_signal = agg.select(*KEYS, "signal", ess.alias("ess"), (F.col("_alive") & (F.col("_w0") > 0)).alias("_limited"))
    return by_signal.groupBy(*KEYS).agg(
        F.max(F.when(F.col("signal") == "bulk", F.col("ess"))).alias("ess_bulk"),
        F.min(F.when(F.col("signal") != "bulk", F.col("ess"))).alias("ess_tail"),
        F.coalesce(F.max("_limited"), F.lit(False)).alias("lag_limited"))


def with_errors(summary: DataFrame, ess: DataFrame, seconds: Column | float) -> DataFrame:
    """Monte Carlo standard error and effective draws per second of compute time."""
    per = seconds if isinstance(seconds, Column) else F.lit(float(seconds))
    return summary.join(ess, KEYS).withColumns({
        "mcse": F.try_divide(F.col("std"), F.sqrt("ess_bulk")),
        "ess_per_sec": F.try_divide(F.col("ess_bulk"), per)})


def _pairs(params: list) -> list:
    return [(a, b) for i, a in enumerate(params) for b in params[i + 1:]]


_PAIR_SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")
_PARTIAL = "run {run}, pair int, cell int, sums array<double>, n long"


def _pair_totals(k: int, bins: int):
    """Sums and cell counts of all pairs of ``k`` parameters over the draws of a task, run by run.

    Rows arrive ordered by draw.  They are laid out as one matrix row per draw; products of that
    matrix with its pattern of present values are the sums of every pair at once.
    """
    first, second = np.triu_indices(k, 1)

    def totals(x: np.ndarray, bin_of: np.ndarray) -> list:
        present = (~np.isnan(x)).astype(float)
        x = np.nan_to_num(x)
        once, square = x.T @ present, (x * x).T @ present
        sums = [m[first, second] for m in (present.T @ present, once, once.T, square, square.T, x.T @ x)]
        cells = np.zeros((len(first), bins * bins), np.int64)
        if bins:
            for p, (i, j) in enumerate(zip(first, second)):
                both = (bin_of[:, i] >= 0) & (bin_of[:, j] >= 0)
                cells[p] = np.bincount(bin_of[both, i] * bins + bin_of[both, j], minlength=bins * bins)
        return [np.stack(sums, axis=1), cells]

    def partial(run, kind, sums: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
        pair, cell = np.nonzero(cells)
        return pa.RecordBatch.from_arrays(
            [pa.array([run] * (len(sums) + len(pair)), kind),
             pa.array(np.concatenate([np.arange(len(sums)), pair]), pa.int32()),
             pa.array(np.concatenate([np.full(len(sums), -1), cell]), pa.int32()),
             pa.array([*sums.tolist(), *[None] * len(pair)], pa.list_(pa.float64())),
             pa.array(np.concatenate([np.zeros(len(sums), np.int64), cells[pair, cell]]), pa.int64())],
            names=["run", "pair", "cell", "sums", "n"])

    def run(batches):
        rest, held, kind = None, None, None

        def draws_of(rows: pa.Table):
            """(run, totals) of whole draws."""
            codes = [rows.column(c).combine_chunks().dictionary_encode() for c in ("run", "chain", "iter")]
            ids = np.stack([c.indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in codes])
            new = np.concatenate([[True], (ids[:, 1:] != ids[:, :-1]).any(axis=0)])
            draw, run_of = np.cumsum(new) - 1, ids[0][new]
            x, bin_of = np.full((draw[-1] + 1, k), np.nan), np.full((draw[-1] + 1, k), -1, np.int64)
            at = rows.column("_p").to_numpy()
            x[draw, at], bin_of[draw, at] = rows.column("_x").to_numpy(), rows.column("_bin").to_numpy()
            names = codes[0].dictionary.to_pylist()
            for start, end in zip(*_segments(run_of)):
                yield names[run_of[start]] if run_of[start] >= 0 else None, totals(x[start:end], bin_of[start:end])

        def add(rows: pa.Table):
            nonlocal held
            for name, found in draws_of(rows):
                if held and held[0] == name:
                    held = (name, [a + b for a, b in zip(held[1], found)])
                else:
                    if held:
                        yield partial(held[0], kind, *held[1])
                    held = (name, found)

        for b in batches:
            if not b.num_rows:
                continue
            kind = b.schema.field("run").type
            rows = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b])
            cut = _last_draw(rows)    # the last draw may go on in the next batch
            rest = rows.slice(cut)
            if cut:
                yield from add(rows.slice(0, cut))
        if rest is not None:
            yield from add(rest)
        if held:
            yield partial(held[0], kind, *held[1])
    return run


def _segments(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return start, np.append(start[1:], len(codes))


def _last_draw(rows: pa.Table) -> int:
    """Where the last draw of ordered rows begins."""
    at = rows.num_rows - 1
    last = [rows.column(c)[at] for c in ("run", "chain", "iter")]
    while at and all(rows.column(c)[at - 1] == v for c, v in zip(("run", "chain", "iter"), last)):
        at -= 1
    return at


def pair_partials(draws: DataFrame, params: list, bins: int = 0) -> DataFrame:
    """Sums, and counts over a grid of ``bins`` cells a side, of every pair of parameters: one stored table of partial results.

    Draws of one iteration meet in one task by a hash of (run, chain, iter), the only shuffle of their size; neither a run nor a
    parameter is a key of it.  A task then hands on its sums and the cells it has seen: what is shuffled
    after that depends on pairs, cells and tasks, not on the draws.  Values are centred at their mean first, so sums of
    squares keep their digits.
    """
    k = len(params)
    picked = draws.filter(F.col("param").isin(*params) & F.col("value").isNotNull())
    shape = written(picked.groupBy("run", "param").agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.avg("value").alias("_mean")), "ranges")
    at = F.floor(F.try_divide(F.col("value") - F.col("_lo"), (F.col("_hi") - F.col("_lo")) / max(bins, 1)))
    rows = picked.join(shape, ["run", "param"]).select(
        "run", "chain", "iter", (F.array_position(F.array(*[F.lit(p) for p in params]), F.col("param")) - 1).cast("int").alias("_p"),
        (F.col("value") - F.col("_mean")).alias("_x"), F.least(F.lit(bins - 1), F.coalesce(at, F.lit(0))).cast("int").alias("_bin"))
    together = rows.repartition("run", "chain", "iter").sortWithinPartitions("run", "chain", "iter", "_p", "_x")
    return written(together.mapInArrow(_pair_totals(k, bins), _PARTIAL.format(run=draws.schema["run"].dataType.simpleString())), "pairs")


def _named(pair: Column, params: list) -> list[Column]:
    return [F.array(*[F.lit(p[i]) for p in _pairs(params)])[pair].alias(n) for i, n in enumerate(("param_a", "param_b"))]


def param_correlation(draws: DataFrame, params: list, partials: DataFrame | None = None) -> DataFrame:
    """Correlation of every pair of the named parameters over the draws that have both, ``(run, param_a, param_b, corr)``.

    Null where a parameter does not vary.  ``partials`` takes a result of ``pair_partials``, with any ``bins``.
    """
    partials = pair_partials(draws, params) if partials is None else partials
    sums = partials.filter(F.col("cell") < 0).groupBy("run", "pair").agg(
        *[F.sum(F.col("sums")[i]).alias(c) for i, c in enumerate(_PAIR_SUMS)])

    def product(ab: str, a: str, b: str) -> Column:
        return F.col(ab) - F.try_divide(F.col(a) * F.col(b), F.col("n"))

    corr = F.try_divide(product("sab", "sa", "sb"), F.sqrt(product("saa", "sa", "sa") * product("sbb", "sb", "sb")))
    return sums.filter(F.col("n") > 0).select("run", *_named(F.col("pair"), params), corr.alias("corr"))


def pair_hist2d(draws: DataFrame, params: list, bins: int = 20, partials: DataFrame | None = None) -> DataFrame:
    """Counts over a grid for every pair of parameters, ``(run, param_a, param_b, bin_a, bin_b, n)``.

    ``partials`` takes a result of ``pair_partials`` with the same ``bins``.
    """
    partials = pair_partials(draws, params, bins) if partials is None else partials
    counts = partials.filter(F.col("cell") >= 0).groupBy("run", "pair", "cell").agg(F.sum("n").alias("n"))
    return counts.select("run", *_named(F.col("pair"), params), F.floor(F.col("cell") / bins).cast("int").alias("bin_a"),
                         (F.col("cell") % bins).alias("bin_b"), "n")


def density(draws: DataFrame, points: int = 64, bins: int = 512, pad: float = 4.0) -> DataFrame:
    """Gaussian kernel density of every chain on an even grid, ``(run, param, chain, i, x, density)``.

    Draws are counted into ``bins`` cells first; the kernel then runs over
    cells, so the cost after one pass does not depend on the number of draws.
    The bandwidth is 0.9 min(sd, IQR/1.34) n^(-1/5); the grid reaches ``pad``
    bandwidths beyond the data.  A constant chain has no density: one row at its
    value with a null density.
    """
    keys = [*KEYS, "chain"]
    stats = draws.groupBy(*keys).agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.stddev_samp("value").alias("_sd"),
        F.count("value").cast("double").alias("_n"))
    iqr = ranks.exact_quantiles(draws, keys, "value", {"_q1": 0.25, "_q3": 0.75})
    spread = F.when(F.col("_q3") > F.col("_q1"), F.least(F.col("_sd"), (F.col("_q3") - F.col("_q1")) / 1.34)) \
        .otherwise(F.col("_sd"))
    every = written(stats.join(iqr, keys).withColumn("_bw", 0.9 * spread * F.pow("_n", F.lit(-0.2))), "bandwidth")
    wide = F.coalesce((F.col("_bw") > 0) & (F.col("_hi") > F.col("_lo")), F.lit(False))
    stats = every.filter(wide)
    constant = every.filter(~wide).select(*keys, F.lit(0).alias("i"), F.col("_lo").alias("x"), F.lit(None).cast("double").alias("density"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    cell = F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("_lo")) / width)).cast("int")
    counted = (draws.join(stats, keys).withColumn("_cell", cell)
               .groupBy(*keys, "_lo", "_hi", "_bw", "_n", "_cell").agg(F.count(F.lit(1)).alias("_cnt")))
    x = (F.col("_lo") - pad * F.col("_bw")
         + F.col("i") * ((F.col("_hi") - F.col("_lo") + 2 * pad * F.col("_bw")) / (points - 1)))
    centre = F.col("_lo") + (F.col("_cell") + 0.5) * width
    u = (F.col("x") - centre) / F.col("_bw")
    curve = (counted.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", x)
             .groupBy(*keys, "i", "x", "_n", "_bw").agg(F.sum(F.col("_cnt") * F.exp(-0.5 * u * u)).alias("_k")))
    curve = curve.select(*keys, "i", "x",
                         (F.col("_k") / (F.col("_n") * F.col("_bw") * float(np.sqrt(2 * np.pi)))).alias("density"))
    return curve.union(constant)


def trace(draws: DataFrame, thin: int = 1, width: int = split.BLOCK) -> DataFrame:
    """Ordered draws of every chain with the running mean, every ``thin``-th iteration."""
    out = split.running_mean(draws, [*KEYS, "chain"], "iter", "value", width=width)
    return out.filter((F.col("iter") - 1) % thin == 0) if thin > 1 else out


def prior_posterior(summary: DataFrame, priors: DataFrame) -> DataFrame:
    """Posterior statistics beside the prior's family and mean; ``shift`` in prior means."""
    cols = ["param", "family", "prior_mean"]
    return (summary.join(priors.select(*cols), ["param"])
            .withColumn("shift", F.try_divide(F.col("mean") - F.col("prior_mean"), F.abs("prior_mean"))))


def recovery_check(summary: DataFrame, truth: DataFrame, variances: list = ()) -> DataFrame:
    """Posterior against the true value: bias and whether the 95 % interval covers it.

    Parameters named in ``variances`` are reported as standard deviations.
    """
    joined = summary.join(truth.select("param", "true_value"), ["param"], "left")
    root = F.col("param").isin(*variances) if variances else F.lit(False)

    def shown(c: str) -> Column:
        return F.when(root, F.sqrt(F.greatest(F.col(c), F.lit(0.0)))).otherwise(F.col(c))

    out = joined.withColumns({c: shown(c) for c in ("mean", "q025", "q975", "true_value")})
    return out.withColumns({
        "bias": F.col("mean") - F.col("true_value"),
        "covered": F.col("true_value").between(F.col("q025"), F.col("q975"))})


def compare_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """The same parameter in two runs: means, intervals, % change and interval overlap.

    Each side holds one run.  A parameter of one side only stays, with nulls for the other.
    """
    cols = ["mean", "q025", "q975"]
    a = left.select("param", *[F.col(c).alias(f"{c}_a") for c in cols])
    b = right.select("param", *[F.col(c).alias(f"{c}_b") for c in cols])
    return a.join(b, ["param"], "full_outer").withColumns({
        "change_pct": 100 * F.try_divide(F.col("mean_b") - F.col("mean_a"), F.abs("mean_a")),
        "overlap": (F.col("q025_a") <= F.col("q975_b")) & (F.col("q025_b") <= F.col("q975_a"))})

"""Auxiliary moments of a panel: vector autoregression of order one, distance to a target."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import written


def _complete(panel: DataFrame, keys: list, cols: list, order: str) -> DataFrame:
    """Rows that have all values and all values of the row before, with their number in the series."""
    w = Window.partitionBy(*keys).orderBy(order)
    lagged = panel.select(*keys, order, *cols, *[F.lag(c).over(w).alias(f"_l_{c}") for c in cols])
    return lagged.dropna(subset=[*cols, *[f"_l_{c}" for c in cols]]).withColumn("_t", F.row_number().over(w)).drop(order)


def _cross_products(complete: DataFrame, keys: list, cols: list) -> DataFrame:
    """(keys, _n, _xx, _xy): the sums of products of lagged values, and of lagged with present ones."""
    xx = F.array(*[F.sum(F.col(f"_l_{a}") * F.col(f"_l_{b}")) for a in cols for b in cols])
    xy = F.array(*[F.sum(F.col(f"_l_{a}") * F.col(b)) for a in cols for b in cols])
    return complete.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), xx.alias("_xx"), xy.alias("_xy"))


def _fields(panel: DataFrame, keys: list, more: str) -> str:
    return ", ".join([*(f"`{c}` {panel.schema[c].dataType.simpleString()}" for c in keys), more])


def _square(column: pd.Series, k: int) -> np.ndarray:
    return np.stack(column.to_numpy()).reshape(-1, k, k)


def _triangles(keys: list, columns: list):
    """Triangular factor of the rows of each key in a batch, and of factors met before: as few rows as there are columns."""
    def run(batches):
        for pdf in batches:
            for key, rows in pdf.groupby(keys, dropna=False, sort=False):
                r = np.linalg.qr(rows[columns].to_numpy(float), mode="r")
                yield pd.DataFrame(dict(zip(keys, key)) | {c: r[:, i] for i, c in enumerate(columns)})
    return run


def var1_ols(panel: DataFrame, keys: list, cols: list, order: str = "quarter_idx") -> DataFrame:
    """Least squares of ``Y_t`` on ``Y_(t-1)`` without intercept, per key.

    Returns ``(keys, pos, predictor, target, coef)``; ``pos`` counts column by
    column (the target varies slowest).  Rows of lagged and present values are reduced to
    triangular factors batch by batch, and the stacked factors of a key to one: products, which would square the condition
    number, are never formed.  The last solve sees 2k rows per key.
    """
    k = len(cols)
    lagged = [f"_l_{c}" for c in cols]
    complete = _complete(panel, keys, cols, order).select(*keys, *[F.col(c).cast("double").alias(c) for c in [*lagged, *cols]])
    small = complete.mapInPandas(_triangles(keys, [*lagged, *cols]), complete.schema)
    kinds = _fields(panel, keys, "pos int, predictor string, target string, coef double")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(pdf[[*lagged, *cols]].to_numpy(float), mode="r")
        coef = np.linalg.lstsq(r[:, :k], r[:, k:], rcond=None)[0]
        first = {c: pdf[c].iloc[0] for c in keys}
        return pd.DataFrame({"pos": np.arange(k * k, dtype=np.int32), "predictor": np.tile(cols, k),
                             "target": np.repeat(cols, k), "coef": coef.T.reshape(-1)}).assign(**first)

    return small.groupBy(*keys).applyInPandas(solve, kinds)


def moment_covariance(panel: DataFrame, keys: list, cols: list, lags: int, order: str = "quarter_idx") -> DataFrame:
    """Long-run covariance of the coefficients of ``var1_ols`` and its inverse, ``(keys, pos_a, pos_b, cov, weight)``.

    The sum of the outer products of lagged values and residuals over time and over ``lags`` leads and
    lags, with Bartlett weights, equals the sum of the outer products of their running sums over
    ``lags + 1`` rows, partial ones at both ends included, divided by ``lags + 1``.  So one window and one sum of
    products per key give it, positive semidefinite by construction; no pair of rows is formed.  Sandwiched
    between inverse cross products of the lagged values it is the covariance of the coefficients.  ``weight`` is its (pseudo-)inverse,
    the matrix to pass to ``moment_distance``.
    """
    k, m = len(cols), len(cols) ** 2
    complete = _complete(panel, keys, cols, order)
    gram = _cross_products(complete, keys, cols)

    def fit(batches):
        for pdf in batches:
            if not pdf.empty:
                coef = np.linalg.pinv(_square(pdf["_xx"], k)) @ _square(pdf["_xy"], k)
                yield pdf.drop(columns="_xy").assign(_b=list(coef.reshape(-1, m)))

    fitted = written(gram.mapInPandas(fit, _fields(panel, keys, "_n long, _xx array<double>, _b array<double>")), "fitted")
    scores = [f"_s{p}" for p in range(m)]
    residual = {c: F.col(c) - sum(F.col(f"_l_{a}") * F.col("_b")[i * k + j] for i, a in enumerate(cols)) for j, c in enumerate(cols)}
    rows = complete.join(fitted.select(*keys, "_b"), keys).select(
        *keys, "_t", *[(F.col(f"_l_{a}") * residual[c]).alias(f"_s{j * k + i}") for j, c in enumerate(cols) for i, a in enumerate(cols)])
    if lags:    # zeros after the end, so the last partial sums have a row
        beyond = F.explode(F.sequence((F.col("_n") + 1).cast("int"), (F.col("_n") + lags).cast("int"))).alias("_t")
        rows = rows.unionByName(fitted.select(*keys, beyond, *[F.lit(0.0).alias(c) for c in scores]))
    w = Window.partitionBy(*keys).orderBy("_t").rowsBetween(-lags, 0)
    sums = rows.select(*keys, *[F.sum(c).over(w).alias(c) for c in scores])
    triangle = [(p, q) for p in range(m) for q in range(p, m)]
    outer = sums.groupBy(*keys).agg(F.array(*[F.sum(F.col(f"_s{p}") * F.col(f"_s{q}")) for p, q in triangle]).alias("_outer"))

    def invert(batches):
        upper = tuple(np.array(c) for c in zip(*triangle))
        a, b = (c.reshape(-1) for c in np.indices((m, m)))
        for pdf in batches:
            if pdf.empty:
                continue
            long_run = np.zeros((len(pdf), m, m))
            long_run[:, upper[0], upper[1]] = np.stack(pdf["_outer"].to_numpy()) / (lags + 1)
            long_run[:, upper[1], upper[0]] = long_run[:, upper[0], upper[1]]
            bread = np.kron(np.eye(k), np.linalg.pinv(_square(pdf["_xx"], k)))
            cov = bread @ long_run @ bread
            weight = np.linalg.pinv(cov, hermitian=True)
            out = {c: np.repeat(pdf[c].to_numpy(), m * m) for c in keys}
            yield pd.DataFrame(out | {
                "pos_a": np.tile(a.astype(np.int32), len(pdf)), "pos_b": np.tile(b.astype(np.int32), len(pdf)),
                "cov": cov.reshape(-1), "weight": weight.reshape(-1)})

    return (outer.join(fitted.select(*keys, "_xx"), keys)
            .mapInPandas(invert, _fields(panel, keys, "pos_a int, pos_b int, cov double, weight double")))


# Open bounds of the business-cycle model's parameters; null means unbounded.
BOUNDS = {
    "alpha": (0.0, 1.0),
    "beta": (0.0, 1.0),
    "delta": (0.0, 1.0),
    "gamma": (0.0, None),
    "rho": (-1.0, 1.0),
}
PENALTY = 1e6


def out_of_bounds(bounds: dict = BOUNDS) -> Column:
    """True when a parameter leaves its open interval or is missing."""
    bad = F.lit(False)
    for name, (lo, hi) in bounds.items():
        inside = F.lit(True)
        if lo is not None:
            inside = inside & (F.col(name) > lo)
        if hi is not None:
            inside = inside & (F.col(name) < hi)
        bad = bad | ~F.coalesce(inside, F.lit(False))
    return bad


def moment_distance(simulated: DataFrame, target: DataFrame, keys: list, on: list = ("pos",),
                    moment: str = "coef", weight: str | None = None, matrix: DataFrame | None = None) -> DataFrame:
    """``J = d' W d`` per candidate, ``d = simulated - target``.

    W is the identity, or diagonal from the target's column ``weight``, or ``matrix``: rows
    ``(pos_a, pos_b, weight)`` such as one key of ``moment_covariance``; pairs it does not name weigh nothing.
    ``simulated`` may carry a boolean ``out_of_bounds``; such a candidate costs
    ``PENALTY`` whatever its moments are, and so does one that lacks any moment of the target.
    """
    wanted = target.select(*on, F.col(moment).alias("_target"),
                           (F.col(weight) if weight else F.lit(1.0)).alias("_w"),
                           F.count(F.lit(1)).over(Window.partitionBy()).alias("_all"))    # one row per moment
    gap = F.col(moment) - F.col("_target")
    outside = F.col("out_of_bounds") if "out_of_bounds" in simulated.columns else F.lit(False)
    joined = simulated.join(wanted, list(on), "left").withColumn("_out", outside)
    if matrix is None:
        distance = F.sum(F.col("_w") * gap * gap)
    else:
        lines = matrix.groupBy(F.col("pos_a").alias("pos")).agg(F.map_from_entries(F.collect_list(F.struct("pos_b", "weight"))).alias("_line"))
        joined = joined.join(written(lines, "lines"), "pos", "left")    # one row per moment
        gaps = F.collect_list(F.when(gap.isNotNull(), F.struct(F.col("pos"), gap.alias("gap"), F.col("_line").alias("line"))))
        distance = _quadratic(F.array_sort(gaps, lambda a, b: (a["pos"] - b["pos"]).cast("int")))
    found = joined.groupBy(*keys).agg(
        distance.alias("_j"), F.max("_out").alias("_out"), F.count(gap).alias("_found"), F.max("_all").alias("_all"))
    failed = F.coalesce(F.col("_out"), F.lit(False)) | F.coalesce(F.col("_found") < F.col("_all"), F.lit(True))
    return found.select(*keys, F.when(failed, F.lit(PENALTY)).otherwise(F.col("_j")).alias("distance"))


def _quadratic(gaps: Column) -> Column:
    """Sum over all pairs of a candidate's gaps of gap, weight and gap; the list holds one entry per moment."""
    def line(a: Column) -> Column:
        return F.aggregate(gaps, F.lit(0.0), lambda s, b: s + F.coalesce(F.try_element_at(a["line"], b["pos"]), F.lit(0.0)) * b["gap"])

    return F.aggregate(gaps, F.lit(0.0), lambda s, a: s + a["gap"] * line(a))

"""Posterior means or draws to policy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.policy import laffer_peak, sweep
from panelspark.operators.steady import CALIBRATED, PARAMS


def parameter_rows(spark, *rows: dict) -> DataFrame:
    """Parameter table from dicts; calibrated values fill what a row leaves out."""
    full = [{**CALIBRATED, **r} for r in rows]
    extra = sorted({k for r in full for k in r if k not in PARAMS})
    names = [*extra, *PARAMS]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], names)


def rows_from_means(summary: DataFrame, params: list, run: str = "run") -> DataFrame:
    """Posterior means per run as one wide parameter row, completed with the calibrated values."""
    wide = summary.groupBy(run).pivot("param", list(params)).agg(F.first("mean"))
    missing = {n: F.lit(v) for n, v in CALIBRATED.items() if n not in wide.columns}
    return wide.withColumns(missing) if missing else wide


def revenue_peaks(params: DataFrame, ids: list, n: int) -> DataFrame:
    """Peak of total revenue for every instrument and parameter row."""
    return laffer_peak(sweep(params, ids, n=n), ids)

"""Draws to the posterior report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import draws as d


def posterior_report(draws: DataFrame, seconds: float | DataFrame) -> DataFrame:
    """One row per run and parameter: moments, error, sample sizes, R-hat and quantiles.

    ``seconds`` is the compute time: one number, or a table (run, seconds).  A run the table
    does not name has no draws per second; of repeated runs the longest time counts.
    """
    prepared = d.prepare(draws, along=True)
    summary = d.posterior_summary(draws)
    if isinstance(seconds, DataFrame):
        summary = summary.join(seconds.groupBy("run").agg(F.max("seconds").alias("_seconds")), "run", "left")
        seconds = F.col("_seconds")
    report = d.with_errors(summary, d.effective_sample_size(draws, prepared=prepared), seconds)
    rhat = d.rhat_rank(draws, prepared).select(*d.KEYS, "rhat")
    quantiles = prepared.quantiles.select(*d.KEYS, *d.QUANTILES)
    return report.join(rhat, d.KEYS).join(quantiles, d.KEYS).select(
        *d.KEYS, "mean", "std", "mcse", "ess_bulk", "ess_tail", "lag_limited", "rhat", "ess_per_sec", *d.QUANTILES)

"""Quarterly periods: ``YYYY-Qq`` strings, first-of-quarter dates, integer quarter index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_quarter(text: Column) -> Column:
    """``"1995-Q3"`` to the first day of the quarter; null when malformed."""
    ok = text.rlike(r"^\d{4}.*[1-4]$")
    year = F.substring(text, 1, 4).try_cast("int")
    quarter = F.substring(text, -1, 1).try_cast("int")
    return F.when(ok, F.make_date(year, (quarter - 1) * 3 + 1, F.lit(1)))


def quarter_label(date: Column) -> Column:
    return F.concat(F.year(date).cast("string"), F.lit("-Q"), F.quarter(date).cast("string"))


def quarter_start(date: Column) -> Column:
    return F.trunc(date.cast("date"), "quarter")


def quarter_idx(date: Column) -> Column:
    """Consecutive integer of the quarter, for range frames and gap checks."""
    return (F.year(date) * 4 + F.quarter(date) - 1).cast("int")


def with_period(df: DataFrame, col: str, date: str = "date", idx: str = "quarter_idx") -> DataFrame:
    """Add the quarter's first day and its integer index parsed from a period string."""
    parsed = df.withColumn(date, parse_quarter(F.col(col).cast("string")))
    return parsed.withColumn(idx, quarter_idx(F.col(date)))

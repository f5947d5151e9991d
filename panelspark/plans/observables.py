"""Raw period tables to observable growth series, one lazy plan for any number of keys."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.periods import parse_quarter, quarter_idx
from panelspark.operators.align import align, asof_interpolate, first_match
from panelspark.operators.series import dlog, implicit_deflator, period_filter, real_series, rolling_sum
from panelspark.sources.tables import LINE, read_delimited

# Observable and level columns, in output order.
SERIES = ["c", "inv", "Gc", "Gh", "wh"]
LAST_DATE = "2024-10-01"
FIRST_DATE = "1996-01-01"


@dataclass(frozen=True)
class RawFile:
    """A delimited file: its ``period`` column, its ``values`` (name here: name in the file), and its ``key`` column or else constant."""

    path: str
    period: str
    values: dict
    key: str | None = None
    constant: str | None = None
    sep: str = ","
    filters: dict = field(default_factory=dict)    # column: wanted value, for long files of several dimensions


def read_periods(spark: SparkSession, raw: RawFile, key: str, annual: bool = False) -> DataFrame:
    """(key, date or year, values, LINE) of a raw file; rows whose period cannot be read are dropped."""
    columns = list(dict.fromkeys([raw.period, *raw.values.values(), *([raw.key] if raw.key else []), *raw.filters]))
    df = read_delimited(spark, raw.path, columns, raw.period, raw.sep, types=dict.fromkeys(raw.values.values(), "double"), lines=True)
    for column, wanted in raw.filters.items():
        df = df.filter(F.col(column) == wanted)
    period = F.col(raw.period).try_cast("int").alias("year") if annual else parse_quarter(F.col(raw.period)).alias("date")
    df = df.select((F.col(raw.key) if raw.key else F.lit(raw.constant)).alias(key), period,
                   *[F.col(c).alias(n) for n, c in raw.values.items()], LINE)
    return df.filter(F.col("year" if annual else "date").isNotNull())


def tables_from_files(spark: SparkSession, accounts: RawFile, nominal: RawFile, labour: RawFile, taxes: RawFile, population: RawFile,
                      key: str = "series_key", last_date: str = LAST_DATE, first_date: str = FIRST_DATE,
                      on_nonpositive: str = "error") -> tuple[DataFrame, DataFrame]:
    """Raw files to the observables and to the levels they come from, both from ``first_date`` on.

    Values by file: ``GDP``, ``C``, ``I``; ``GDP_nominal``; ``D1``; ``IS``, ``IRPF``; ``value`` per year.  Columns are
    found by the header of each file; of repeated periods the first line counts.
    """
    sources = [read_periods(spark, raw, key) for raw in (accounts, nominal, labour, taxes)]
    levels = level_series(*sources, read_periods(spark, population, key, annual=True), [key], last_date)
    return observables(levels, [key], first_date, on_nonpositive), period_filter(levels, lo=first_date)


def _first(df: DataFrame, on: list) -> DataFrame:
    rest = F.struct(*[c for c in df.columns if c not in on])
    return first_match(df, on, LINE if LINE in df.columns else rest).drop(LINE)


def level_series(accounts: DataFrame, nominal: DataFrame, labour: DataFrame, taxes: DataFrame,
                 population: DataFrame, keys: list, last_date: str = LAST_DATE, mode: str = "rows") -> DataFrame:
    """Real per-capita levels on the dates that every source has.

    ``accounts``: keys, date, GDP, C, I at constant prices; ``nominal``: keys,
    date, GDP_nominal; ``labour``: keys, date, D1; ``taxes``: keys, date, IS,
    IRPF; ``population``: keys, year, value.  Taxes are summed over four rows
    first and deflated with the current quarter afterwards.  Of a source's rows of one key and
    date the first counts: the first in file order where the source carries ``LINE``, else the smallest.
    """
    on = [*keys, "date"]
    joined = align(*[_first(df, on) for df in (accounts, nominal, labour, period_filter(taxes, hi=last_date))], on=on)
    joined = asof_interpolate(joined, _first(population, [*keys, "year"]), keys, name="pop").withColumn("quarter_idx", quarter_idx(F.col("date")))
    joined = joined.withColumn("deflator", implicit_deflator(F.col("GDP_nominal"), F.col("GDP")))
    rolled = rolling_sum(joined, keys, "IS", "IS_4q", mode=mode)
    rolled = rolling_sum(rolled, keys, "IRPF", "IRPF_4q", mode=mode)
    defl, pop, one = F.col("deflator"), F.col("pop"), F.lit(1.0)
    return rolled.withColumns({
        "lev_c": real_series(F.col("C"), one, pop),
        "lev_inv": real_series(F.col("I"), one, pop),
        "lev_Gc": real_series(F.col("IS_4q"), defl, pop),
        "lev_Gh": real_series(F.col("IRPF_4q"), defl, pop),
        "lev_wh": real_series(F.col("D1"), defl, pop),
    }).select(*keys, "date", "quarter_idx", *[f"lev_{s}" for s in SERIES])


def observables(levels: DataFrame, keys: list, first_date: str = FIRST_DATE, on_nonpositive: str = "error") -> DataFrame:
    """100 x log growth of every level, from ``first_date`` on (full four-quarter sums at both ends)."""
    out = dlog(levels, keys, {f"obs_{s}": f"lev_{s}" for s in SERIES}, on_nonpositive=on_nonpositive)
    return period_filter(out, lo=first_date).select(*keys, "date", *[f"obs_{s}" for s in SERIES])


def annualised_growth(panel: DataFrame, keys: list, value: str, first_date: str, n: int = 4) -> DataFrame:
    """Growth of the trailing ``n``-quarter sum after the burn-in; the library's smallest full plan."""
    rolled = rolling_sum(panel, keys, value, "rolled", n=n)
    growth = dlog(rolled, keys, {"growth": "rolled"}, on_nonpositive="null")
    return period_filter(growth, lo=first_date).select(*keys, "date", "rolled", "growth")

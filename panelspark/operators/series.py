"""Transformations of quarterly panels.

Windows here run within one series, whose length is bounded by the calendar
(one row per key and period); long tables such as draws use ``split`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.periods import quarter_idx
from panelspark.operators.ordered import number_in_order
from panelspark.session import written


def period_filter(df: DataFrame, lo: str | None = None, hi: str | None = None, closed: str = "both",
                  date: str = "date") -> DataFrame:
    """Rows with ``lo <= date <= hi``; ``closed`` is both, left, right or neither."""
    d = F.col(date)
    if lo is not None:
        bound = F.lit(lo).cast("date")
        df = df.filter(d >= bound if closed in ("both", "left") else d > bound)
    if hi is not None:
        bound = F.lit(hi).cast("date")
        df = df.filter(d <= bound if closed in ("both", "right") else d < bound)
    return df


def quarters_between(df: DataFrame, day: str, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Rows whose day lies in a quarter from that of ``lo`` to before that of ``hi``.

    The bounds are compared with the raw column, so a scan takes them as its own filter;
    use it before days are truncated and summed, ``period_filter`` on dates that are quarters already.
    """
    column, kind = F.col(day), df.schema[day].dataType
    for bound, keep in ((lo, column.__ge__), (hi, column.__lt__)):
        if bound is not None:
            df = df.filter(keep(F.trunc(F.lit(bound).cast("date"), "quarter").cast(kind)))
    return df


def real_series(nominal: Column, deflator: Column, pop: Column) -> Column:
    """Real value per head; null when the deflator or the population is zero."""
    return F.try_divide(F.try_divide(nominal, deflator), pop)


def implicit_deflator(nominal: Column, real: Column) -> Column:
    return F.try_divide(nominal, real)


def split_samples(df: DataFrame, samples: list | DataFrame, date: str = "date") -> DataFrame:
    """Label rows with every sample they belong to.

    ``samples`` lists ``(name, first date or None, day after the last or None)``: an array literal, so no
    join is needed.  Or it is a table ``(sample, lo, hi)`` of any length with the same meaning.
    """
    if isinstance(samples, DataFrame):
        return _split_by_table(df, samples, date)
    defs = F.array(*[
        F.struct(F.lit(n).alias("sample"), F.lit(lo).cast("date").alias("lo"), F.lit(hi).cast("date").alias("hi"))
        for n, lo, hi in samples])
    d = F.col(date)
    hit = F.filter(defs, lambda s: (s["lo"].isNull() | (d >= s["lo"])) & (s["hi"].isNull() | (d < s["hi"])))
    return df.withColumn("_s", F.explode(hit)).withColumn("sample", F.col("_s.sample")).drop("_s")


def _split_by_table(df: DataFrame, samples: DataFrame, date: str) -> DataFrame:
    """Samples meet the distinct dates in bins of a year, then the rows by date.

    An interval is listed under every year it touches within the dates there are, so the join is an equality and its
    size is that of dates times the samples they really lie in.  Null dates belong to samples without any bound.
    """
    day, lo, hi = F.col("_day"), F.col("_lo"), F.col("_hi")
    days = written(df.select(F.col(date).cast("date").alias("_day")).distinct(), "days")    # at most one row per day of the calendar
    span = days.agg(F.min(F.year(day)).alias("_from"), F.max(F.year(day)).alias("_to")).withColumn("_one", F.lit(1))
    table = samples.select("sample", F.col("lo").cast("date").alias("_lo"), F.col("hi").cast("date").alias("_hi"))
    begin, end = F.greatest(F.coalesce(F.year(lo), "_from"), "_from"), F.least(F.coalesce(F.year(hi), "_to"), "_to")
    years = F.when(begin <= end, F.sequence(begin, end))
    open_ended = F.when(lo.isNull() & hi.isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.array().cast("array<int>"))
    binned = table.withColumn("_one", F.lit(1)).join(span, "_one").withColumn(
        "_year", F.explode(F.concat(F.coalesce(years, F.array().cast("array<int>")), open_ended)))
    dated = days.withColumn("_day_year", F.year(day))
    inside = day.isNull() | ((lo.isNull() | (day >= lo)) & (hi.isNull() | (day < hi)))
    matches = dated.join(binned, F.col("_day_year").eqNullSafe(F.col("_year"))).filter(inside).select("_day", "sample")
    found = written(matches, "samples")
    return df.join(found, df[date].cast("date").eqNullSafe(found["_day"])).select(*[df[c] for c in df.columns], found["sample"])


def sample_info(df: DataFrame, keys: list, date: str = "date") -> DataFrame:
    """Row count and date range per sample."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


BLOCK_ROWS = 1 << 17    # rows of one unkeyed series that a task sees at once


def _first_of_all(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with one aggregate over all of it, a single row, beside every row."""
    only = df.agg(value.alias(name)).withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(only), "_one").drop("_one")


def over_rows(df: DataFrame, order: str, back: int, columns: dict) -> DataFrame:
    """Add columns over the ``back`` rows before each row, and the row itself, of one series without keys.

    Rows are numbered by ranges of ``order`` and cut into blocks; a block also gets the last ``back`` rows of the block before
    it, so no task holds more than a block.  ``columns`` maps a name to a function of the window.
    """
    size = max(BLOCK_ROWS, back)
    placed = number_in_order(df, [order], "_place")
    own, last = F.floor(F.col("_place") / size), F.col("_place") % size >= size - back
    sent = placed.withColumn("_own", own).withColumn("_block", F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy("_block").orderBy("_place").rowsBetween(-back, 0)
    out = sent.select("*", *[f(w).alias(n) for n, f in columns.items()]).filter(F.col("_block") == F.col("_own"))
    return out.select(*[c for c in df.columns if c not in columns], *columns)


def _within(keys: list) -> Window:
    """Window over one series; a window without keys would put a whole table into one task."""
    if not keys:
        raise ValueError("this operator works within a series and needs keys")
    return Window.partitionBy(*keys)


def _row_frame(keys: list, order: str, n: int) -> Window:
    return _within(keys).orderBy(order).rowsBetween(-(n - 1), 0)


def rolling_sum(df: DataFrame, keys: list, value: str, name: str, n: int = 4, order: str = "quarter_idx",
                mode: str = "rows", min_periods: int = 1) -> DataFrame:
    """Trailing sum over ``n`` rows, or over ``n`` calendar quarters with ``mode="calendar"``.

    The start of a series sums the rows it has.  The two modes differ at a gap:
    rows reach further back, the calendar does not.  Without ``keys`` the
    calendar form spreads each row over the quarters it enters and adds up, so
    no single task sees the whole series.
    """
    if mode not in ("rows", "calendar"):
        raise ValueError(f"unknown mode {mode}")
    if not keys and mode == "rows":
        return over_rows(df, order, n - 1, {name: lambda w: F.when(F.count(value).over(w) >= min_periods, F.sum(value).over(w))})
    if not keys:
        spread = (df.select(F.explode(F.sequence(F.col(order), F.col(order) + n - 1)).alias(order), value)
                  .groupBy(order).agg(F.sum(value).alias(name), F.count(value).alias("_n")))
        out = df.join(spread, [order], "left")
        return out.withColumn(name, F.when(F.col("_n") >= min_periods, F.col(name))).drop("_n")
    w = (_row_frame(keys, order, n) if mode == "rows"
         else _within(keys).orderBy(order).rangeBetween(-(n - 1), 0))
    return df.withColumn(name, F.when(F.count(value).over(w) >= min_periods, F.sum(value).over(w)))


def dlog(df: DataFrame, keys: list, cols: dict, order: str = "quarter_idx", scale: float = 100.0,
         on_nonpositive: str = "error", drop_first: bool = True) -> DataFrame:
    """``scale * (ln x_t - ln x_(t-1))`` for several columns in one window.

    ``cols`` maps output name to input column.  The first row of a series has no
    difference and is dropped.  A value <= 0 raises, or gives null with
    ``on_nonpositive="null"``.  Without ``keys`` each row meets its successor by
    ``order + 1`` in an aggregation, so the one series is not gathered in one
    task; a row whose predecessor is missing is then dropped as well.
    """
    def log(x: str) -> Column:
        if on_nonpositive == "null":
            return F.when(F.col(x) > 0, F.ln(x))
        bad = F.raise_error(F.concat(F.lit(f"dlog: {x} is not positive: "), F.col(x).cast("string"))).cast("double")
        return F.when(F.col(x) <= 0, bad).otherwise(F.ln(x))

    out = df.withColumns({f"_ln_{o}": log(x) for o, x in cols.items()})
    if not keys:
        moves = [F.struct(F.lit(0).alias("_ahead"), F.col(order).alias("_to")),
                 F.struct(F.lit(1).alias("_ahead"), (F.col(order) + 1).alias("_to"))]
        sent = out.select(*out.columns, F.inline(F.array(*moves)))
        own, before = F.col("_ahead") == 0, F.col("_ahead") == 1
        kept = [c for c in df.columns if c != order]
        met = sent.groupBy(F.col("_to").alias(order)).agg(
            F.max(own).alias("_own"), F.max(before).alias("_met"),
            *[F.max(F.when(own, F.col(c))).alias(c) for c in kept],
            *[(F.lit(scale) * (F.max(F.when(own, F.col(f"_ln_{o}"))) - F.max(F.when(before, F.col(f"_ln_{o}"))))).alias(o)
              for o in cols])
        met = met.filter(F.col("_own") & F.col("_met") if drop_first else F.col("_own"))
        return met.select(*df.columns, *cols)
    w = _within(keys).orderBy(order)
    out = out.withColumns({
        **{o: F.lit(scale) * (F.col(f"_ln_{o}") - F.lag(f"_ln_{o}").over(w)) for o in cols},
        "_pos": F.row_number().over(w)})
    if drop_first:
        out = out.filter(F.col("_pos") > 1)
    return out.drop("_pos", *[f"_ln_{o}" for o in cols])


def index_base(df: DataFrame, keys: list, value: str, name: str, order: str = "quarter_idx",
               base: float = 100.0) -> DataFrame:
    """``base`` times the value relative to the first row of the series; without ``keys``, of the whole table."""
    if not keys:
        first = _first_of_all(df, F.min_by(value, order), "_first")
        return first.withColumn(name, F.lit(base) * F.try_divide(F.col(value), F.col("_first"))).drop("_first")
    w = _within(keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.lit(base) * F.try_divide(F.col(value), F.first(value).over(w)))


def signed_stack(df: DataFrame, keys: list, rank: str, value: str) -> DataFrame:
    """Stacking positions of signed parts: positives grow up, negatives grow down.

    Adds ``pos_bottom, pos_top, neg_bottom, neg_top`` in ``rank`` order within ``keys``.
    """
    w = _within(keys).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    pos, neg = F.greatest(F.col(value), F.lit(0.0)), F.least(F.col(value), F.lit(0.0))
    return (df.withColumns({"pos_top": F.sum(pos).over(w), "neg_top": F.sum(neg).over(w)})
            .withColumns({"pos_bottom": F.col("pos_top") - pos, "neg_bottom": F.col("neg_top") - neg}))


def thin(df: DataFrame, keys: list, k: int, order: str = "quarter_idx") -> DataFrame:
    """Every ``k``-th row of a series, starting with the first; without ``keys``, of the whole table."""
    if not keys:
        return number_in_order(df, [order], "_place").filter(F.col("_place") % k == 0).drop("_place")
    w = _within(keys).orderBy(order)
    return df.withColumn("_pos", F.row_number().over(w)).filter((F.col("_pos") - 1) % k == 0).drop("_pos")


def axis_ticks(df: DataFrame, keys: list, date: str = "date", every_years: int = 4) -> DataFrame:
    """First quarters of every ``every_years``-th year, and the first row if it is a January."""
    january = F.month(date) == 1
    started = df.withColumn("_start", F.min(date).over(_within(keys))) if keys else _first_of_all(df, F.min(date), "_start")
    return (started.filter(january & ((F.col(date) == F.col("_start")) | (F.year(date) % every_years == 0)))
            .drop("_start").withColumn("tick", F.year(date).cast("string")))


def sort_by_period(df: DataFrame, keys: list = (), date: str = "date") -> DataFrame:
    return df.orderBy(*keys, date)


def head_by_time(df: DataFrame, keys: list, n: int, order: str = "quarter_idx") -> DataFrame:
    """First ``n`` rows of every series, or of the whole table without ``keys``; Spark limits each group before the shuffle."""
    if not keys:
        return df.orderBy(order).limit(n)
    w = _within(keys).orderBy(order)
    return df.withColumn("_pos", F.row_number().over(w)).filter(F.col("_pos") <= n).drop("_pos")


def wide_to_long(df: DataFrame, ids: list, cols: list, variable: str = "series", value: str = "value") -> DataFrame:
    return df.unpivot(ids, cols, variable, value)


def long_to_wide(df: DataFrame, ids: list, variable: str, value: str, names: list) -> DataFrame:
    """Pivot over known names, so no extra job collects them; at most one value per cell."""
    return df.groupBy(*ids).pivot(variable, names).agg(F.first(value, ignorenulls=True))


def ratio_calibration(numerator: DataFrame, denominator: DataFrame, keys: list, base_years: list, impute_before: int,
                      year: str = "year") -> DataFrame:
    """Quarterly ratio of two annual tables, constant within the year.

    ``numerator`` and ``denominator`` carry ``keys, year, value``.  Where the
    denominator is missing before ``impute_before``, the mean over
    ``base_years`` stands in.
    """
    base = (denominator.filter(F.col(year).isin(*base_years)).groupBy(*keys)
            .agg(F.avg("value").alias("_base")))
    joined = (numerator.select(*keys, year, F.col("value").alias("_num"))
              .join(denominator.select(*keys, year, F.col("value").alias("_den")), [*keys, year], "left"))
    joined = joined.join(base, keys, "left")
    den = F.coalesce(F.col("_den"), F.when(F.col(year) < impute_before, F.col("_base")))
    return (joined.withColumn("ratio", F.try_divide(F.col("_num"), den))
            .withColumn("quarter", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])))
            .withColumn("date", F.make_date(F.col(year), F.col("quarter") * 3 - 2, F.lit(1)))
            .withColumn("quarter_idx", quarter_idx(F.col("date")))
            .select(*keys, "date", "quarter_idx", "ratio"))

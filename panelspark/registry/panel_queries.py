"""Period tables: sources, alignment, transformations."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import numeric, periods
from panelspark.operators import align, labels, series
from panelspark.plans.observables import RawFile, annualised_growth, level_series, observables, tables_from_files
from panelspark.registry.base import (VIEWS, contributions, money, quarterly, register, rounded, sql, table)
from panelspark.session import scratch_path, written
from panelspark.sources import checked
from panelspark.sources import tables as io

KEY = ["series_key"]


# -- sources and sinks --------------------------------------------------------------
_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("delimited_roundtrip", sql(
    "SELECT series_key, strftime(date, '%Y') || '-Q' || CAST(quarter(date) AS VARCHAR) AS period, date, quarter_idx, v "
    "FROM q5", "q5"))
def delimited_roundtrip(spark, sf):
    path = scratch_path(spark, "delimited")
    q = quarterly(spark, sf).withColumn("period", periods.quarter_label(F.col("date")))
    io.write_table(q, path, ["series_key", "period", "v"], sep=";")
    back = io.read_delimited(spark, path, ["series_key", "period", "v"], "period", sep=";", types={"v": "double"})
    return periods.with_period(back, "period").select("series_key", "period", "date", "quarter_idx", "v")


@register("sdmx_roundtrip", sql(
    "SELECT series_key AS geo, 'A' AS freq, 'NR' AS unit, CAST(year(date) AS VARCHAR) AS period, sum(v) AS value "
    "FROM q5 WHERE series_key IN ('1-URGENT', '5-LOW') GROUP BY 1, 4", "q5").replace("sum(v)", "round(sum(v), 2)"))
def sdmx_roundtrip(spark, sf):
    path = scratch_path(spark, "sdmx")
    yearly = quarterly(spark, sf).groupBy("series_key", F.year("date").alias("year")).agg(F.round(F.sum("v"), 2).alias("v"))
    filled = {"freq": F.lit("A"), "unit": F.lit("NR"), "geo": F.col("series_key"),
              "TIME_PERIOD": F.col("year").cast("string"), "OBS_VALUE": F.col("v").cast("string")}
    long = yearly.select(*[filled.get(c, F.lit(None).cast("string")).alias(c) for c in io.distinct_names(io.SDMX_COLUMNS)])
    io.write_table(long, path)
    back = io.read_sdmx(spark, path, {"freq": "A", "geo": ["1-URGENT", "5-LOW"]})
    return back


@register("observables_readback", sql(
    "SELECT date, " + ", ".join(f"sum(v) FILTER (series_key = '{p}') AS p{p[0]}" for p in _PRIORITIES) + " FROM q5 GROUP BY 1", "q5"))
def observables_readback(spark, sf):
    path = scratch_path(spark, "observables")
    wide = series.long_to_wide(quarterly(spark, sf), ["date"], "series_key", "v", _PRIORITIES)
    short = {p: f"p{p[0]}" for p in _PRIORITIES}
    io.write_table(wide.withColumnsRenamed(short), path, ["date", *reversed(short.values())], fmt="parquet")
    return io.read_observables(spark, path, list(short.values()))


_FAULTY = ("SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 3 THEN NULL ELSE CAST(year(o_orderdate) AS VARCHAR) END AS period, "
           "CASE WHEN o_orderkey % 23 = 5 THEN NULL ELSE o_totalprice END AS v, o_orderkey % 29 = 7 AS wide, "
           "o_orderkey % 23 = 5 AS unparsed FROM orders")


def _faulty_files(spark, sf):
    """Every order as a line of one of two sets of files with other column orders, some lines with a planted fault."""
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")
    amount = F.when(key % 23 == 5, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    lines = o.select(key.cast("string").alias("key"), F.when(key % 19 != 3, F.year("o_orderdate").cast("string")).alias("period"),
                     F.concat(amount, F.when(key % 29 == 7, ";more").otherwise("")).alias("v"), (key % 2).alias("_set"))
    paths = []
    for k, order in enumerate((["key", "period", "v"], ["v", "key", "period"])):
        paths.append(scratch_path(spark, "faulty"))
        # without quoting, a separator inside a field makes one field too many
        lines.filter(F.col("_set") == k).select(*order).write.option("quote", "\0").csv(paths[-1], header=True, sep=";")
    return paths


def _read_faulty(spark, sf):
    return checked.read_checked(spark, _faulty_files(spark, sf), ["key", "period", "v"], "period", ";", types={"key": "long", "v": "double"})


@register("delimited_checked", sql(
    "SELECT o_orderkey AS key, period, v FROM f WHERE period IS NOT NULL AND NOT wide", f=_FAULTY))
def delimited_checked(spark, sf):
    return _read_faulty(spark, sf)[0]


@register("delimited_rejects", sql(
    "SELECT reason, col AS \"column\", reason = 'does not parse' AS kept, count(*) AS n FROM (SELECT "
    "CASE WHEN wide THEN 'field count' WHEN period IS NULL THEN 'no period' WHEN unparsed THEN 'does not parse' END AS reason, "
    "CASE WHEN wide THEN NULL WHEN period IS NULL THEN 'period' WHEN unparsed THEN 'v' END AS col FROM f) "
    "WHERE reason IS NOT NULL GROUP BY 1, 2, 3", f=_FAULTY))
def delimited_rejects(spark, sf):
    return _read_faulty(spark, sf)[1].groupBy("reason", "column", "kept").agg(F.count(F.lit(1)).alias("n"))


# -- periods and scalar functions -----------------------------------------------------
@register("quarter_parse", sql(
    "SELECT period, make_date(CAST(substr(period, 1, 4) AS INTEGER), CAST(right(period, 1) AS INTEGER)*3 - 2, 1) AS date, "
    "CAST(CAST(substr(period, 1, 4) AS INTEGER)*4 + CAST(right(period, 1) AS INTEGER) - 1 AS INTEGER) AS quarter_idx, "
    "count(*) AS n FROM (SELECT strftime(o_orderdate, '%Y') || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS period "
    "FROM orders) GROUP BY 1"))
def quarter_parse(spark, sf):
    text = table(spark, sf, "orders").select(periods.quarter_label(F.col("o_orderdate")).alias("period"))
    counted = text.groupBy("period").agg(F.count(F.lit(1)).alias("n"))
    return periods.with_period(counted, "period").select("period", "date", "quarter_idx", "n")


@register("date_parts", sql(
    "SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(month(o_orderdate) AS INTEGER) AS mon, "
    "CAST((month(o_orderdate)-1)//3 + 1 AS INTEGER) AS qtr, "
    "CAST(substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 4) AS INTEGER) AS parsed_year, count(*) AS n FROM orders "
    "GROUP BY 1, 2, 3, 4"))
def date_parts(spark, sf):
    d = F.col("o_orderdate")
    return (table(spark, sf, "orders")
            .select(F.year(d).alias("yr"), F.month(d).alias("mon"), F.quarter(d).alias("qtr"),
                    F.substring(d.cast("date").cast("string"), 1, 4).try_cast("int").alias("parsed_year"))
            .groupBy("yr", "mon", "qtr", "parsed_year").agg(F.count(F.lit(1)).alias("n")))


@register("scalar_functions", sql(
    "SELECT l_returnflag, l_linestatus, round(avg(ln(l_extendedprice)), 6) AS mean_log, "
    "round(avg(exp(-l_discount)), 6) AS mean_exp, round(avg(sqrt(l_quantity)), 6) AS mean_sqrt, "
    "round(avg(pow(l_quantity, 1.5)), 4) AS mean_pow, round(avg(abs(l_discount - l_tax)), 6) AS mean_abs, "
    "round(avg(least(greatest(l_discount*20, 0.05), 0.96)), 6) AS mean_clamp "
    "FROM lineitem GROUP BY 1, 2"))
def scalar_functions(spark, sf):
    return (table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.avg(F.ln("l_extendedprice")), 6).alias("mean_log"),
        F.round(F.avg(F.exp(-F.col("l_discount"))), 6).alias("mean_exp"),
        F.round(F.avg(F.sqrt("l_quantity")), 6).alias("mean_sqrt"),
        F.round(F.avg(F.pow("l_quantity", F.lit(1.5))), 4).alias("mean_pow"),
        F.round(F.avg(F.abs(F.col("l_discount") - F.col("l_tax"))), 6).alias("mean_abs"),
        F.round(F.avg(numeric.clamp(F.col("l_discount") * 20, 0.05, 0.96)), 6).alias("mean_clamp")))


_GAPS = ("SELECT event_type, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN CAST('NaN' AS DOUBLE) "
         "ELSE value END AS x FROM events")


def _gaps(spark, sf):
    x = F.when(F.col("event_id") % 3 == 0, F.lit(None)).when(F.col("event_id") % 3 == 1, F.lit(float("nan"))) \
        .otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_type", x.cast("double").alias("x"))


@register("missing_defaults", sql(
    "SELECT event_type, round(sum(CASE WHEN x IS NULL OR isnan(x) THEN -1.0 ELSE x END), 4) AS with_default, "
    "count(CASE WHEN isnan(x) THEN NULL ELSE x END) AS n_valid FROM g GROUP BY 1", g=_GAPS))
def missing_defaults(spark, sf):
    return _gaps(spark, sf).groupBy("event_type").agg(
        F.round(F.sum(numeric.or_default(F.col("x"), -1.0)), 4).alias("with_default"),
        F.count(numeric.or_null(F.col("x"))).alias("n_valid"))


@register("valid_points", sql(
    "SELECT event_type, max(x) AS peak, count(*) AS n FROM g WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY 1", g=_GAPS))
def valid_points(spark, sf):
    return numeric.valid_rows(_gaps(spark, sf), "x").groupBy("event_type").agg(
        F.max("x").alias("peak"), F.count(F.lit(1)).alias("n"))


# -- filters, samples, real series ------------------------------------------------------
@register("period_filter", sql(
    "SELECT series_key, date, v FROM q5 WHERE date >= DATE '1996-01-01' AND date < DATE '2000-01-01'", "q5"))
def period_filter(spark, sf):
    return quarterly(spark, sf, lo="1996-01-01", hi="2000-01-01").select(*KEY, "date", "v")


_SAMPLES = [("early", None, "1998-01-01"), ("full", None, None), ("late", "1998-01-01", None)]
_SAMPLE_SQL = ("SELECT s.sample, q5.* FROM q5 JOIN (VALUES ('early', NULL, DATE '1998-01-01'), ('full', NULL, NULL), "
               "('late', DATE '1998-01-01', NULL)) s(sample, lo, hi) "
               "ON (lo IS NULL OR date >= lo) AND (hi IS NULL OR date < hi)")


@register("sample_split", sql("SELECT sample, series_key, date, v FROM s", "q5", s=_SAMPLE_SQL))
def sample_split(spark, sf):
    return series.split_samples(quarterly(spark, sf), _SAMPLES).select("sample", *KEY, "date", "v")


# -- one long series without keys: event values in the order of their ids ------------------
def _one_series(spark, sf):
    return table(spark, sf, "events").select("event_id", "value").filter(F.col("value").isNotNull())


@register("rolling_sum_row_mode", sql(
    "SELECT event_id, round(sum(value) OVER (ORDER BY event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS rolled "
    "FROM events WHERE value IS NOT NULL"))
def rolling_sum_row_mode(spark, sf):
    out = series.rolling_sum(_one_series(spark, sf), [], "value", "rolled", n=7, order="event_id")
    return rounded(out.select("event_id", "rolled"), 4, "rolled")


@register("thin_one_series", sql(
    "SELECT event_id, round(100*value/nullif(first_value, 0), 4) AS idx FROM (SELECT event_id, value, row_number() OVER w AS rn, "
    "first(value) OVER w AS first_value FROM events WHERE value IS NOT NULL WINDOW w AS (ORDER BY event_id)) WHERE (rn - 1) % 16 = 0"))
def thin_one_series(spark, sf):
    indexed = series.index_base(_one_series(spark, sf), [], "value", "idx", order="event_id")
    return rounded(series.thin(indexed, [], 16, order="event_id").select("event_id", "idx"), 4, "idx")


_EXPANDING = ("SELECT 'to ' || CAST(y AS VARCHAR) AS sample, NULL::DATE AS lo, make_date(y, 7, 1) AS hi FROM yrs UNION ALL "
              "SELECT 'five from ' || CAST(y AS VARCHAR), make_date(y, 4, 1), make_date(y + 5, 4, 1) FROM yrs")


@register("sample_table", sql(
    "SELECT sample, series_key, date, v FROM q5 JOIN smp ON (lo IS NULL OR date >= lo) AND (hi IS NULL OR date < hi)", "q5",
    yrs="SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders", smp=_EXPANDING))
def sample_table(spark, sf):
    """Expanding and rolling samples, one of each per year of the data."""
    years = table(spark, sf, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    name = F.col("y").cast("string")
    none = F.lit(None).cast("date")
    samples = years.select(F.inline(F.array(
        F.struct(F.concat(F.lit("to "), name).alias("sample"), none.alias("lo"), F.make_date("y", F.lit(7), F.lit(1)).alias("hi")),
        F.struct(F.concat(F.lit("five from "), name).alias("sample"), F.make_date("y", F.lit(4), F.lit(1)).alias("lo"),
                 F.make_date(F.col("y") + 5, F.lit(4), F.lit(1)).alias("hi")))))
    return series.split_samples(quarterly(spark, sf), samples).select("sample", *KEY, "date", "v")


@register("sample_info", sql(
    "SELECT sample, series_key, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM s GROUP BY 1, 2",
    "q5", s=_SAMPLE_SQL))
def sample_info(spark, sf):
    return series.sample_info(series.split_samples(quarterly(spark, sf), _SAMPLES), ["sample", *KEY])


_SIDES = ("SELECT series_key, date, sum(v) AS total, sum(v) FILTER (o_orderstatus = 'F') AS done, "
          "sum(v) FILTER (o_orderstatus = 'O') AS still_open FROM q5s GROUP BY 1, 2")


def _sides(spark, sf):
    status = F.col("o_orderstatus")
    return quarterly(spark, sf, "o_orderstatus").groupBy(*KEY, "date", "quarter_idx").agg(
        F.sum("v").alias("total"), F.sum(F.when(status == "F", F.col("v"))).alias("done"),
        F.sum(F.when(status == "O", F.col("v"))).alias("still_open"),
        F.sum(F.when(status == "P", F.col("v"))).alias("partial"))


@register("real_per_capita", sql(
    "SELECT series_key, date, round(done / (total / nullif(still_open, 0)) / 1000.0, 6) AS real_pc FROM d",
    "q5s", d=_SIDES))
def real_per_capita(spark, sf):
    d = _sides(spark, sf)
    defl = series.implicit_deflator(F.col("total"), F.col("still_open"))
    return rounded(d.select(*KEY, "date", series.real_series(F.col("done"), defl, F.lit(1000.0)).alias("real_pc")),
                   6, "real_pc")


# -- alignment ------------------------------------------------------------------------------
def _by_status(spark, sf, status):
    return (quarterly(spark, sf, "o_orderstatus").filter(F.col("o_orderstatus") == status)
            .select(*KEY, "date", F.col("v").alias(f"v_{status.lower()}")))


_HALF = "SELECT series_key, date, v FROM q5s WHERE o_orderstatus = "


@register("align_sources", sql(
    "SELECT series_key, date, f.v AS v_f, o.v AS v_o, p.v AS v_p FROM f JOIN o USING (series_key, date) "
    "JOIN p USING (series_key, date)", "q5s", f=_HALF + "'F'", o=_HALF + "'O'", p=_HALF + "'P'"))
def align_sources(spark, sf):
    return align.align(*[_by_status(spark, sf, s) for s in "FOP"], on=[*KEY, "date"])


@register("common_periods", sql(
    "SELECT series_key, date FROM f INTERSECT SELECT series_key, date FROM o INTERSECT SELECT series_key, date FROM p", "q5s",
    f=_HALF + "'F'", o=_HALF + "'O'", p=_HALF + "'P'"))
def common_periods(spark, sf):
    return align.common_periods(*[_by_status(spark, sf, s) for s in "FOP"], on=[*KEY, "date"])


@register("first_match", sql(
    "SELECT o_custkey, date, o_orderkey, o_totalprice FROM (SELECT o_custkey, "
    "CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date, o_orderkey, o_totalprice, "
    "row_number() OVER (PARTITION BY o_custkey, date_trunc('quarter', o_orderdate) ORDER BY o_orderkey) AS rn "
    "FROM orders) WHERE rn = 1"))
def first_match(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_custkey", periods.quarter_start(F.col("o_orderdate")).alias("date"), "o_orderkey", "o_totalprice")
    return align.first_match(o, ["o_custkey", "date"], "o_orderkey")


_ANNUAL = ("SELECT series_key, CAST(year(date) AS INTEGER) AS year, round(sum(v), 2) AS value FROM q5 "
           "WHERE year(date) NOT IN (1995, 1998, 2001) GROUP BY 1, 2")


@register("asof_interpolate", sql(
    "SELECT q.series_key, q.date, round(CASE WHEN a.year IS NULL THEN (SELECT min_by(value, year) FROM an z WHERE "
    "z.series_key = q.series_key) WHEN a.nv IS NULL THEN a.value ELSE a.value*(1-(quarter(q.date)-1)/4.0) "
    "+ a.nv*((quarter(q.date)-1)/4.0) END, 4) AS interpolated FROM q5 q ASOF LEFT JOIN (SELECT *, "
    "lead(value) OVER (PARTITION BY series_key ORDER BY year) AS nv FROM an) a "
    "ON q.series_key = a.series_key AND CAST(year(q.date) AS INTEGER) >= a.year", "q5", an=_ANNUAL))
def asof_interpolate(spark, sf):
    q = quarterly(spark, sf)
    annual = (q.filter(~F.year("date").isin(1995, 1998, 2001)).groupBy(*KEY, F.year("date").alias("year"))
              .agg(F.round(F.sum("v"), 2).alias("value")))
    return rounded(align.asof_interpolate(q.select(*KEY, "date"), annual, KEY), 4, "interpolated")


@register("missing_keys", sql(
    "SELECT DISTINCT c.c_custkey AS custkey FROM customer c WHERE NOT EXISTS "
    "(SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' AND o.o_orderpriority = '1-URGENT')"))
def missing_keys(spark, sf):
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"))
    have = (table(spark, sf, "orders").filter((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"))
            .select(F.col("o_custkey").alias("custkey")))
    return align.missing_keys(wanted, have, ["custkey"])


@register("relabel_names", sql(
    "SELECT c_nationkey, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS label, CASE c_mktsegment "
    "WHEN 'BUILDING' THEN 'Construction' WHEN 'MACHINERY' THEN 'Machines' ELSE c_mktsegment END AS segment, "
    "count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20 GROUP BY 1, 2, 3"))
def relabel_names(spark, sf):
    names = table(spark, sf, "nation").filter("n_nationkey < 20").select(
        F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("label"))
    c = table(spark, sf, "customer").withColumn("code", F.col("c_nationkey").cast("string"))
    c = labels.relabel(c, "code", names)
    c = labels.relabel(c, "c_mktsegment", {"BUILDING": "Construction", "MACHINERY": "Machines"}, name="segment")
    return c.groupBy("c_nationkey", "label", "segment").agg(F.count(F.lit(1)).alias("n"))


@register("ratio_calibration", sql(
    "SELECT series_key, make_date(yr, q*3-2, 1) AS date, CAST(yr*4 + q - 1 AS INTEGER) AS quarter_idx, "
    "round(num / coalesce(den, CASE WHEN yr < 1998 THEN base END), 6) AS ratio FROM n LEFT JOIN d USING (series_key, yr) "
    "LEFT JOIN (SELECT series_key, avg(den) AS base FROM d WHERE yr BETWEEN 1998 AND 2000 GROUP BY 1) USING (series_key) "
    "CROSS JOIN (VALUES (1), (2), (3), (4)) t(q)",
    n="SELECT o_orderpriority AS series_key, CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(count(*) AS DOUBLE) AS num "
      "FROM orders GROUP BY 1, 2",
    d="SELECT o_orderpriority AS series_key, CAST(year(o_orderdate) AS INTEGER) AS yr, "
      "CAST(count(DISTINCT o_custkey) AS DOUBLE) AS den FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY 1, 2"))
def ratio_calibration(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("series_key"),
                                          F.year("o_orderdate").alias("year"), "o_custkey")
    num = o.groupBy(*KEY, "year").agg(F.count(F.lit(1)).cast("double").alias("value"))
    den = (o.filter(F.col("year") >= 1998).groupBy(*KEY, "year")
           .agg(F.count_distinct("o_custkey").cast("double").alias("value")))
    return rounded(series.ratio_calibration(num, den, KEY, [1998, 1999, 2000], 1998), 6, "ratio")


# -- transformations ---------------------------------------------------------------------------
_GAPPED = "SELECT * FROM q5 WHERE quarter_idx % 7 <> 3"


def _gapped(spark, sf):
    return quarterly(spark, sf).filter(F.col("quarter_idx") % 7 != 3)


@register("rolling_sum_rows", sql(
    "SELECT series_key, date, round(sum(v) OVER (PARTITION BY series_key ORDER BY quarter_idx "
    "ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 2) AS rolled FROM g", "q5", g=_GAPPED))
def rolling_sum_rows(spark, sf):
    return rounded(series.rolling_sum(_gapped(spark, sf), KEY, "v", "rolled").select(*KEY, "date", "rolled"), 2, "rolled")


@register("rolling_sum_calendar", sql(
    "SELECT series_key, date, CASE WHEN count(v) OVER w >= 3 THEN round(sum(v) OVER w, 2) END AS rolled FROM g "
    "WINDOW w AS (PARTITION BY series_key ORDER BY quarter_idx RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)",
    "q5", g=_GAPPED))
def rolling_sum_calendar(spark, sf):
    out = series.rolling_sum(_gapped(spark, sf), KEY, "v", "rolled", mode="calendar", min_periods=3)
    return rounded(out.select(*KEY, "date", "rolled"), 2, "rolled")


@register("rolling_sum_one_series", sql(
    "SELECT quarter_idx, round(sum(v) OVER (ORDER BY quarter_idx RANGE BETWEEN 3 PRECEDING AND CURRENT ROW), 2) AS rolled "
    "FROM (SELECT quarter_idx, sum(v) AS v FROM g GROUP BY 1)", "q5", g=_GAPPED))
def rolling_sum_one_series(spark, sf):
    one = _gapped(spark, sf).groupBy("quarter_idx").agg(F.sum("v").alias("v"))
    out = series.rolling_sum(one, [], "v", "rolled", mode="calendar")
    return rounded(out.select("quarter_idx", "rolled"), 2, "rolled")


_DLOG = ("SELECT series_key, date, quarter_idx, 100.0*(ln(v) - lag(ln(v)) OVER (PARTITION BY series_key "
         "ORDER BY quarter_idx)) AS growth FROM q5")


@register("dlog", sql("SELECT series_key, date, round(growth, 6) AS growth FROM d WHERE growth IS NOT NULL", "q5", d=_DLOG))
def dlog(spark, sf):
    out = series.dlog(quarterly(spark, sf), KEY, {"growth": "v"})
    return rounded(out.select(*KEY, "date", "growth"), 6, "growth")


@register("dlog_one_series", sql(
    "SELECT quarter_idx, round(100.0*(ln(v) - ln(p)), 6) AS growth FROM (SELECT a.quarter_idx, a.v, b.v AS p FROM t a JOIN t b "
    "ON b.quarter_idx = a.quarter_idx - 1)", "q5", g=_GAPPED, t="SELECT quarter_idx, sum(v) AS v FROM g GROUP BY 1"))
def dlog_one_series(spark, sf):
    one = _gapped(spark, sf).groupBy("quarter_idx").agg(F.sum("v").alias("v"))
    return rounded(series.dlog(one, [], {"growth": "v"}).select("quarter_idx", "growth"), 6, "growth")


@register("index_base", sql(
    "SELECT series_key, date, round(100.0*v / first_value(v) OVER (PARTITION BY series_key ORDER BY quarter_idx), 6) AS idx "
    "FROM q5 WHERE date >= DATE '1996-01-01'", "q5"))
def index_base(spark, sf):
    out = series.index_base(series.period_filter(quarterly(spark, sf), "1996-01-01"), KEY, "v", "idx")
    return rounded(out.select(*KEY, "date", "idx"), 6, "idx")


@register("signed_stack", sql(
    "SELECT series_key, date, round(sum(greatest(growth, 0)) OVER w - greatest(growth, 0), 6) + 0.0 AS pos_bottom, "
    "round(sum(greatest(growth, 0)) OVER w, 6) + 0.0 AS pos_top, "
    "round(sum(least(growth, 0)) OVER w - least(growth, 0), 6) + 0.0 AS neg_bottom, "
    "round(sum(least(growth, 0)) OVER w, 6) + 0.0 AS neg_top FROM d WHERE growth IS NOT NULL "
    "WINDOW w AS (PARTITION BY date ORDER BY series_key ROWS UNBOUNDED PRECEDING)", "q5", d=_DLOG))
def signed_stack(spark, sf):
    growth = series.dlog(quarterly(spark, sf), KEY, {"growth": "v"})
    out = series.signed_stack(growth, ["date"], "series_key", "growth")
    cols = ["pos_bottom", "pos_top", "neg_bottom", "neg_top"]
    return rounded(out.select(*KEY, "date", *cols), 6, *cols)


@register("thin_rows", sql(
    "SELECT series_key, date, v FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY quarter_idx) AS rn "
    "FROM q5) WHERE (rn - 1) % 16 = 0", "q5"))
def thin_rows(spark, sf):
    return series.thin(quarterly(spark, sf), KEY, 16).select(*KEY, "date", "v")


@register("axis_ticks", sql(
    "SELECT series_key, date, CAST(year(date) AS VARCHAR) AS tick FROM (SELECT *, min(date) OVER "
    "(PARTITION BY series_key) AS d0 FROM q5) WHERE month(date) = 1 AND (date = d0 OR year(date) % 4 = 0)", "q5"))
def axis_ticks(spark, sf):
    return series.axis_ticks(quarterly(spark, sf), KEY).select(*KEY, "date", "tick")


@register("head_by_time", sql(
    "SELECT series_key, date, v FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY quarter_idx) AS rn "
    "FROM q5) WHERE rn <= 12", "q5"))
def head_by_time(spark, sf):
    return series.head_by_time(quarterly(spark, sf), KEY, 12).select(*KEY, "date", "v")


@register("sorted_periods", sql("SELECT series_key, date, v FROM q5 ORDER BY series_key, date", "q5"))
def sorted_periods(spark, sf):
    return series.sort_by_period(quarterly(spark, sf).select(*KEY, "date", "v"), KEY)


@register("long_to_wide", sql(
    "SELECT date, " + ", ".join(f"max(v) FILTER (series_key = '{p}') AS p{p[0]}" for p in _PRIORITIES)
    + " FROM q5 GROUP BY 1", "q5"))
def long_to_wide(spark, sf):
    wide = series.long_to_wide(quarterly(spark, sf), ["date"], "series_key", "v", _PRIORITIES)
    return wide.withColumnsRenamed({p: f"p{p[0]}" for p in _PRIORITIES})


_SIDES_LONG = sql(
    "SELECT series_key, date, 'done' AS series, done AS value FROM d UNION ALL "
    "SELECT series_key, date, 'still_open', still_open FROM d UNION ALL SELECT series_key, date, 'partial', partial FROM d", "q5s",
    d=_SIDES.replace(" AS still_open FROM", " AS still_open, sum(v) FILTER (o_orderstatus = 'P') AS partial FROM"))


@register("wide_to_long_statuses", _SIDES_LONG)
@register("wide_to_long", _SIDES_LONG)
def wide_to_long(spark, sf):
    cols = ["done", "still_open", "partial"]
    return series.wide_to_long(_sides(spark, sf).select(*KEY, "date", *cols), [*KEY, "date"], cols)


@register("component_filter", sql(
    "SELECT variable, component, count(*) AS n FROM ct WHERE component NOT IN ('mean', 'initial_conditions', "
    "'Initial_values', 'constant') GROUP BY 1, 2", "ct"))
def component_filter(spark, sf):
    return (contributions(spark, sf).filter(labels.is_component_shock(F.col("component")))
            .groupBy("variable", "component").agg(F.count(F.lit(1)).alias("n")))


# -- whole plans --------------------------------------------------------------------------------
@register("annualised_growth", sql(
    "SELECT series_key, date, round(rolled, 2) AS rolled, round(growth, 6) AS growth FROM (SELECT *, 100.0*(ln(rolled) "
    "- lag(ln(rolled)) OVER (PARTITION BY series_key ORDER BY quarter_idx)) AS growth FROM r) "
    "WHERE date >= DATE '1996-01-01'", "q5",
    r="SELECT *, sum(v) OVER (PARTITION BY series_key ORDER BY quarter_idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) "
      "AS rolled FROM q5"))
def growth_by_priority(spark, sf):
    return rounded(rounded(annualised_growth(quarterly(spark, sf), KEY, "v", "1996-01-01"), 2, "rolled"), 6, "growth")


_OBS_WIN = "OVER (PARTITION BY series_key ORDER BY quarter_idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
_PAY = "CAST(CASE WHEN o_orderkey % 5 = 0 THEN -o_totalprice ELSE o_totalprice END AS DECIMAL(18,2))"


def _obs_sql(column: str) -> str:
    return f"round(100.0*(ln({column}) - lag(ln({column})) OVER (PARTITION BY series_key ORDER BY quarter_idx)), 6)"


_OBS_CTES = dict(
    q=f"SELECT o_orderpriority AS series_key, {VIEWS['q5'].split('series_key, ')[1].split(', CAST(sum')[0]}, "
      "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS gdp, "
      "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'F') AS DOUBLE) AS cons, "
      "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'O') AS DOUBLE) AS inv, "
      "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'P') AS DOUBLE) AS d1, "
      "CAST(sum(CAST(o_totalprice*(1 + o_custkey % 10) AS DECIMAL(18,2))) AS DOUBLE) AS nom, "
      f"CAST(sum({_PAY}) AS DOUBLE) AS tax1, "
      f"CAST(sum({_PAY}) FILTER (o_orderstatus <> 'P') AS DOUBLE) AS tax2 FROM orders GROUP BY 1, 2, 3",
    pop="SELECT o_orderpriority AS series_key, CAST(year(o_orderdate) AS INTEGER) AS year, "
        "CAST(count(DISTINCT o_custkey) AS DOUBLE) AS value, lead(CAST(count(DISTINCT o_custkey) AS DOUBLE)) OVER "
        "(PARTITION BY o_orderpriority ORDER BY year(o_orderdate)) AS nv FROM orders GROUP BY o_orderpriority, year(o_orderdate)",
    a="SELECT q.*, CASE WHEN nv IS NULL THEN value ELSE value*(1-(quarter(date)-1)/4.0) + nv*(quarter(date)-1)/4.0 END AS pop "
      "FROM q JOIN pop ON q.series_key = pop.series_key AND CAST(year(date) AS INTEGER) = pop.year "
      "WHERE date <= DATE '2001-04-01' AND cons IS NOT NULL AND inv IS NOT NULL AND d1 IS NOT NULL AND tax2 IS NOT NULL",
    lev="SELECT series_key, date, quarter_idx, cons/pop AS lev_c, inv/pop AS lev_inv, "
        f"sum(tax1) {_OBS_WIN}/(nom/gdp)/pop AS lev_Gc, sum(tax2) {_OBS_WIN}/(nom/gdp)/pop AS lev_Gh, "
        "d1/(nom/gdp)/pop AS lev_wh FROM a")
_OBS_SQL = sql(
    "SELECT series_key, date, obs_c, obs_inv, obs_Gc, obs_Gh, obs_wh FROM (SELECT series_key, date, "
    + ", ".join(f"{_obs_sql('lev_' + c)} AS obs_{c}" for c in ("c", "inv", "Gc", "Gh", "wh"))
    + ", row_number() OVER (PARTITION BY series_key ORDER BY quarter_idx) AS rn FROM lev) "
      "WHERE rn > 1 AND date >= DATE '1996-01-01'", **_OBS_CTES)


def _observable_sources(spark, sf):
    """The columns of the five sources, and the population by year, from one pass over the orders."""
    o = table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date")
    o = o.withColumns({"series_key": F.col("o_orderpriority"), "date": periods.quarter_start(day),
                       "_nom": F.col("o_totalprice") * (1 + F.col("o_custkey") % 10),
                       "_tax": F.when(F.col("o_orderkey") % 5 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))})
    status = F.col("o_orderstatus")

    def total(col, where=None):
        amount = F.col(col).cast("decimal(18,2)")
        return F.sum(amount if where is None else F.when(where, amount)).cast("double")

    sources = written(o.groupBy("series_key", "date").agg(
        total("o_totalprice").alias("GDP"), total("o_totalprice", status == "F").alias("C"),
        total("o_totalprice", status == "O").alias("I"), total("o_totalprice", status == "P").alias("D1"),
        total("_nom").alias("GDP_nominal"), total("_tax").alias("IS"), total("_tax", status != "P").alias("IRPF")), "sources")
    return sources, o.groupBy("series_key", F.year("date").alias("year")).agg(F.count_distinct("o_custkey").cast("double").alias("value"))


_SOURCES = (("GDP", "C", "I"), ("GDP_nominal",), ("D1",), ("IS", "IRPF"))


@register("observables", _OBS_SQL)
def observable_series(spark, sf):
    sources, population = _observable_sources(spark, sf)
    parts = [sources.select(*KEY, "date", *cols).dropna(subset=list(cols)) for cols in _SOURCES]
    levels = level_series(*parts, population, KEY, last_date="2001-04-01")
    cols = [f"obs_{s}" for s in ("c", "inv", "Gc", "Gh", "wh")]
    return rounded(observables(levels, KEY, on_nonpositive="null"), 6, *cols)


def _raw_files(spark, sf):
    """The sources as delimited files: columns in another order, and every period once more, with other values, further down."""
    sources, population = _observable_sources(spark, sf)
    files = []
    for cols in (*_SOURCES, ("value",)):
        first = population if cols == ("value",) else sources.select(*KEY, "date", *cols).dropna(subset=list(cols))
        period = F.col("year").cast("string") if cols == ("value",) else periods.quarter_label(F.col("date"))
        again = first.withColumns({c: 3 * F.col(c) + 1 for c in cols})
        lines = first.withColumn("_copy", F.lit(0)).union(again.withColumn("_copy", F.lit(1))).select(
            *[F.col(c).alias(f"{c} total") for c in reversed(cols)], period.alias("TIME_PERIOD"), F.col("series_key").alias("geo"), "_copy")
        path = scratch_path(spark, "raw")
        lines.coalesce(1).sortWithinPartitions("_copy", F.desc("TIME_PERIOD"), "geo").drop("_copy").write.csv(path, header=True, sep=";")
        files.append(RawFile(path, "TIME_PERIOD", {c: f"{c} total" for c in cols}, key="geo", sep=";"))
    return files


@register("observables_from_files", _OBS_SQL)
def observables_from_files(spark, sf):
    growth, _ = tables_from_files(spark, *_raw_files(spark, sf), last_date="2001-04-01", on_nonpositive="null")
    return rounded(growth, 6, *[f"obs_{s}" for s in ("c", "inv", "Gc", "Gh", "wh")])


_LEVELS = ["lev_c", "lev_inv", "lev_Gc", "lev_Gh", "lev_wh"]


@register("levels_from_files", sql(
    "SELECT series_key, date, quarter_idx, " + ", ".join(f"round({c}, 4) AS {c}" for c in _LEVELS)
    + " FROM lev WHERE date >= DATE '1996-01-01'", **_OBS_CTES))
def levels_from_files(spark, sf):
    _, levels = tables_from_files(spark, *_raw_files(spark, sf), last_date="2001-04-01", on_nonpositive="null")
    return rounded(levels, 4, *_LEVELS)

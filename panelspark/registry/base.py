"""Registered queries and the shared views they read.

Every query runs over whole tables.  A view exists twice: as a DataFrame for
Spark and as a common table expression for the SQL check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.periods import quarter_idx, quarter_start
from panelspark.operators.series import quarters_between
from panelspark.operators.split import number_rows
from panelspark.operators.steady import CALIBRATED
from panelspark.session import written

QUERIES: dict = {}
ORACLE: dict = {}

# Estimated parameters used where a part row does not vary them.
POINT = {**CALIBRATED, "alpha": 0.6701, "delta_k": 0.0168, "alpha_u": 0.6375, "phi": 0.9761, "xi": 1.9836,
         "p_ss": 0.0255}


def register(name: str, sql: str | None = None):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def money(col: str):
    """Exact decimal sum, so totals do not depend on the order of addition."""
    return F.sum(F.col(col).cast("decimal(18,2)")).cast("double")


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


# -- orders as a quarterly panel ------------------------------------------------
def quarterly(spark, sf, *extra: str, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Order value per priority (and ``extra`` columns) and quarter, from the quarter of ``lo`` to before that of ``hi``."""
    o = quarters_between(table(spark, sf, "orders"), "o_orderdate", lo, hi)
    day = F.col("o_orderdate").cast("date")
    return (o.select(F.col("o_orderpriority").alias("series_key"), *extra, quarter_start(day).alias("date"),
                     quarter_idx(day).alias("quarter_idx"), "o_totalprice")
            .groupBy("series_key", *extra, "date", "quarter_idx").agg(money("o_totalprice").alias("v")))


# -- events as draws ------------------------------------------------------------
def draws(spark, sf, runs: bool = False, numbered: bool = True, stored: bool = False) -> DataFrame:
    """Event values as draws: type = parameter, user modulo 3 = chain, event order = iteration.

    ``stored`` writes the numbered draws once, for operators that pass over them several times.
    """
    e = table(spark, sf, "events").filter(F.col("event_type").isNotNull() & F.col("user_id").isNotNull())
    run = F.when(F.col("ts") < "2024-01-16", "first").otherwise("second") if runs else F.lit("all")
    base = e.select(run.alias("run"), F.col("event_type").alias("param"),
                    (F.col("user_id") % 3).cast("int").alias("chain"), "event_id", "value")
    if not numbered:
        return base.drop("event_id")
    out = number_rows(base, ["run", "param", "chain"], "event_id").drop("event_id")
    return written(out, "draws") if stored else out


# -- parts as parameter rows ----------------------------------------------------
def params(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    vary = {"alpha": 0.60 + 0.002 * F.col("p_size"), "tau_c_ss": 0.15 + 0.002 * (F.col("p_partkey") % 100)}
    return p.select(F.col("p_partkey").alias("draw_id"), *[vary.get(n, F.lit(v)).alias(n) for n, v in POINT.items()])


# -- orders as shock responses and contributions --------------------------------
COMPONENT = {"1-URGENT": "eps_a", "2-HIGH": "eps_c", "3-MEDIUM": "eps_p", "4-NOT SPECIFIED": "Initial_values",
             "5-LOW": "mean"}


def responses(spark, sf) -> DataFrame:
    """Order value in millions by status (variable), priority (shock) and quarter since 1995 (h)."""
    q = quarterly(spark, sf, "o_orderstatus")
    return q.select(F.lit("all").alias("run"), F.col("o_orderstatus").alias("variable"),
                    F.col("series_key").alias("shock"), (F.col("quarter_idx") - 1995 * 4).alias("h"),
                    (F.col("v") / 1e6).alias("value"))


def contributions(spark, sf) -> DataFrame:
    """Signed order value by status (variable), component and quarter: even keys add, odd keys subtract."""
    from panelspark.operators.labels import lookup
    o = table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date")
    signed = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    return (o.select(F.lit("all").alias("run"), F.col("o_orderstatus").alias("variable"),
                     F.coalesce(lookup(F.col("o_orderpriority"), COMPONENT), "o_orderpriority").alias("component"),
                     quarter_idx(day).alias("t"), signed.alias("s"))
            .groupBy("run", "variable", "component", "t").agg(money("s").alias("value")))


# -- SQL twins --------------------------------------------------------------------
_QUARTER = ("CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date, "
            "CAST(year(o_orderdate)*4 + quarter(o_orderdate) - 1 AS INTEGER) AS quarter_idx")
_CASE = " ".join(f"WHEN o_orderpriority = '{k}' THEN '{v}'" for k, v in COMPONENT.items())
_FIXED = ", ".join(f"CAST({v!r} AS DOUBLE) AS {n}" for n, v in POINT.items() if n not in ("alpha", "tau_c_ss"))

VIEWS = {
    "q5": f"SELECT o_orderpriority AS series_key, {_QUARTER}, "
          "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY 1, 2, 3",
    "q5s": f"SELECT o_orderpriority AS series_key, o_orderstatus, {_QUARTER}, "
           "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY 1, 2, 3, 4",
    "dr": "SELECT 'all' AS run, event_type AS param, CAST(user_id % 3 AS INTEGER) AS chain, "
          "row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY event_id) AS iter, value FROM events",
    "dr2": "SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'first' ELSE 'second' END AS run, event_type AS param, "
           "CAST(user_id % 3 AS INTEGER) AS chain, value FROM events",
    "pr": "SELECT p_partkey AS draw_id, CAST(0.60 AS DOUBLE) + CAST(0.002 AS DOUBLE)*p_size AS alpha, "
          f"CAST(0.15 AS DOUBLE) + CAST(0.002 AS DOUBLE)*(p_partkey % 100) AS tau_c_ss, {_FIXED} FROM part",
    "ir": "SELECT 'all' AS run, o_orderstatus AS variable, series_key AS shock, quarter_idx - 1995*4 AS h, "
          "v / 1e6 AS value FROM q5s",
    "ct": f"SELECT 'all' AS run, o_orderstatus AS variable, CASE {_CASE} ELSE o_orderpriority END AS component, "
          "CAST(year(o_orderdate)*4 + quarter(o_orderdate) - 1 AS INTEGER) AS t, "
          "CAST(sum(CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(18,2))) "
          "AS DOUBLE) AS value FROM orders GROUP BY 1, 2, 3, 4",
}
_NEEDS = {"ir": ["q5s"]}


def sql(body: str, *views: str, **ctes: str) -> str:
    """``WITH`` the named views and extra expressions, in order, then ``body``."""
    parts, seen = [], set()
    for v in views:
        for name in [*_NEEDS.get(v, []), v]:
            if name not in seen:
                seen.add(name)
                parts.append(f"{name} AS ({VIEWS[name]})")
    parts += [f"{name} AS ({text})" for name, text in ctes.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body

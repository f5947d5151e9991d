"""Draws of runs behind commit records, so that a failed rewrite never shows half a run.

``path/draws`` holds one folder per written batch and run, ``path/commits`` one row per run and batch that was
written to its end.  Readers follow the last commit of a run and never list what is not committed.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.sources.tables import DRAWS, SAMPLER_INTERNALS

COMMITS = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("batch", T.StringType()),
    T.StructField("version", T.LongType()),
    T.StructField("n", T.LongType()),
])


def commits(spark: SparkSession, path: str) -> DataFrame:
    """``(run, batch, version, n)`` of every commit; none where nothing was committed yet."""
    try:
        return spark.read.schema(COMMITS).parquet(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMITS)


def stage_draws(draws: DataFrame, path: str) -> str:
    """Writes draws as a new batch, one folder per run, and returns its name; readers do not see it yet."""
    batch = uuid.uuid4().hex
    draws.select(*DRAWS.names).write.partitionBy("run").parquet(f"{path}/draws/batch={batch}")
    return batch


def commit_batch(spark: SparkSession, path: str, batch: str) -> None:
    """Makes all runs of a staged batch the current ones, by one file with the count of rows of each.

    Counts come from what was stored.  Versions follow the last commit; of two commits at once the larger batch name is current.
    """
    stored = spark.read.schema(DRAWS).parquet(f"{path}/draws/batch={batch}")
    last = commits(spark, path).agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"]
    found = stored.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    found.select("run", F.lit(batch).alias("batch"), F.lit(last + 1).cast("long").alias("version"), "n") \
        .coalesce(1).write.mode("append").parquet(f"{path}/commits")


def commit_draws(draws: DataFrame, path: str) -> str:
    """Writes draws and commits them; runs they do not hold stay as they are."""
    batch = stage_draws(draws, path)
    commit_batch(draws.sparkSession, path, batch)
    return batch


def current_runs(spark: SparkSession, path: str) -> DataFrame:
    """The last commit of every run."""
    last = F.max_by(F.struct("batch", "version", "n"), F.struct("version", "batch"))
    return commits(spark, path).groupBy("run").agg(last.alias("last")).select("run", "last.*")


def read_committed(spark: SparkSession, path: str, run: str | None = None, internals: bool = False) -> DataFrame:
    """Long draws of the current batch of every run, or of one; sampler internals are left out by default.

    Batches and runs are folders, so the join with the commits prunes what is scanned.
    """
    now = current_runs(spark, path)
    if run is not None:
        now = now.filter(F.col("run") == run)
    stored = spark.read.schema(T.StructType([*DRAWS.fields, T.StructField("batch", T.StringType())])).parquet(f"{path}/draws")
    now = now.select(F.col("batch").alias("_batch"), F.col("run").alias("_run"))
    df = stored.join(now, F.col("run").eqNullSafe(F.col("_run")) & (F.col("batch") == F.col("_batch")), "left_semi")
    inside = F.col("param").isin(*SAMPLER_INTERNALS)
    return df.filter(inside if internals else ~inside).select(*DRAWS.names)


def damaged_runs(spark: SparkSession, path: str) -> DataFrame:
    """Current runs whose stored rows are not as many as were committed: ``(run, batch, n, stored)``."""
    stored = spark.read.schema(T.StructType([*DRAWS.fields, T.StructField("batch", T.StringType())])).parquet(f"{path}/draws")
    counted = stored.groupBy(F.col("run").alias("_run"), F.col("batch").alias("_batch")).agg(F.count(F.lit(1)).alias("stored"))
    both = current_runs(spark, path).join(counted, F.col("run").eqNullSafe(F.col("_run")) & (F.col("batch") == F.col("_batch")), "left")
    return both.select("run", "batch", "n", F.coalesce("stored", F.lit(0)).alias("stored")).filter("n <> stored")

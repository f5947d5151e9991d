"""Session defaults and the one place where lineage is cut.

``written`` stores an intermediate table in the folder the cluster names in
``spark.checkpoint.dir`` and reads it back.  Two things follow: the table
survives a lost executor, and Catalyst knows its true size, so it broadcasts
the table only when it really is below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise falls back to a shuffle
join.  Nothing in this package hints ``broadcast`` on a side of unknown size.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # room for the cut-point and offset tables of very large inputs; decided by their written size
    "spark.sql.autoBroadcastJoinThreshold": "64m",
}


def build_session(app: str = "panelspark", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = found.get() if found.isDefined() else None
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    named = tempfile.mkdtemp(prefix="panelspark-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/panelspark-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Run ``df`` once, keep the result as a table in the shared folder, read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, ids: list) -> DataFrame:
    """Hash rows by ``ids`` over all shuffle partitions (or cores, if more) before work that multiplies them.

    Few input splits would otherwise do all the work, and all results of an id
    stay in one task, so a partial aggregation leaves one row per group.  The
    explicit number keeps adaptive execution from merging the still small rows.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *ids)

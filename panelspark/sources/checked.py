"""Delimited files of any column order, read with a ledger of what was rejected."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from panelspark.session import written
from panelspark.sources.tables import NULLS

# reasons of the ledger; lines with the first three are dropped, a field that does not parse becomes null
NO_COLUMN, FIELD_COUNT, NO_PERIOD, NOT_PARSED = "column missing", "field count", "no period", "does not parse"


def fields_of(line: Column, sep: str) -> Column:
    """Fields of a delimited line; a field may be quoted, with quotes inside doubled, and may not span lines."""
    plain = F.split(line, re.escape(sep), -1)
    # a separator outside quotes is followed by an even number of quotes
    quoted = F.split(line, re.escape(sep) + '(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    unquoted = F.transform(quoted, lambda x: F.when(
        F.trim(x).rlike('(?s)^".*"$'), F.replace(F.regexp_replace(F.trim(x), '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x))
    return F.when(F.contains(line, F.lit('"')), unquoted).otherwise(plain)


def read_checked(spark: SparkSession, path: str | list, columns: list, period: str, sep: str = ",", nulls: tuple = NULLS,
                 types: dict | None = None, observation: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """The named ``columns`` of delimited files, and the ledger ``(file, line, reason, column, kept)``.

    Every file is read by its own header, so files may order or add columns as they like.  Blank lines and lines equal
    to the header are skipped.  A line is dropped if its file lacks a column, if it has more or fewer fields than the
    header, or if it has no period; the ledger then names the first of these faults.  A field that is not
    one of ``nulls`` and does not parse as its type is null in a line that is kept, with one ledger row per field.  An
    ``observation`` gets the counts ``lines``, ``dropped`` and ``lost`` (fields) when the first table is run; Spark reads
    the lines twice for a global sort and then counts twice, so write the table first or use ``count_rejects``.
    A file without lines gives nothing.  Repeated lines repeat, in the ledger too.
    """
    types = types or {}
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                         F.col("_metadata.file_block_start").alias("block"))
    lines = lines.filter(F.trim("value") != "")
    first = (lines.withColumn("row", F.monotonically_increasing_id()).filter("block = 0")
             .groupBy("file").agg(F.min_by("value", "row").alias("header")))
    names = F.transform(fields_of(F.ltrim(F.col("header"), F.lit("﻿")), sep), F.trim)
    place = {c: f"place {k}" for k, c in enumerate(columns)}
    headers = written(first.select("file", "header", F.size(names).alias("width"),
                                   *[F.array_position(names, F.lit(c)).cast("int").alias(p) for c, p in place.items()]), "headers")
    rows = lines.join(headers, "file").filter(F.col("value") != F.col("header")).withColumn("fields", fields_of(F.col("value"), sep))

    def field(c: str) -> Column:
        text = F.get("fields", F.col(place[c]) - 1)
        return F.when(~F.trim(text).isin(*nulls), text)

    texts = {c: f"text {k}" for k, c in enumerate(columns)}
    rows = rows.select("file", "value", "width", "fields", *place.values(), *[field(c).alias(t) for c, t in texts.items()])
    casts = {c: F.col(t).try_cast(types[c]) if c in types else F.col(t) for c, t in texts.items()}
    fault = F.when(F.array_contains(F.array(*place.values()), 0), F.lit(NO_COLUMN)) \
        .when(F.size("fields") != F.col("width"), F.lit(FIELD_COUNT)) \
        .when(F.col(texts[period]).isNull(), F.lit(NO_PERIOD))
    missing = F.coalesce(*[F.when(F.col(p) == 0, F.lit(c)) for c, p in place.items()])
    of = F.when(fault == NO_COLUMN, missing).when(fault == NO_PERIOD, F.lit(period))
    lost = [F.when(F.col(texts[c]).isNotNull() & casts[c].isNull(), F.struct(F.lit(NOT_PARSED).alias("reason"), F.lit(c).alias("column")))
            for c in types if c in texts]
    kept = fault.isNull()
    empty = F.array().cast("array<struct<reason:string,column:string>>")
    faults = F.when(~kept, F.array(F.struct(fault.alias("reason"), of.alias("column")))).otherwise(F.array_compact(F.array(*lost)) if lost else empty)
    checked = rows.select("file", F.col("value").alias("line"), kept.alias("kept"), faults.alias("faults"),
                          F.struct(*[v.alias(c) for c, v in casts.items()]).alias("found"))
    seen = checked if observation is None else checked.observe(
        observation, F.count(F.lit(1)).alias("lines"), F.count_if(~F.col("kept")).alias("dropped"),
        F.coalesce(F.sum(F.when(F.col("kept"), F.size("faults"))), F.lit(0)).alias("lost"))
    ledger = checked.select("file", "line", "kept", F.explode("faults").alias("fault"))
    return (seen.filter("kept").select("found.*"),
            ledger.select("file", "line", "fault.reason", "fault.column", "kept"))


def count_rejects(ledger: DataFrame) -> DataFrame:
    """Ledger rows per file, reason and column."""
    return ledger.groupBy("file", "reason", "column").agg(F.count(F.lit(1)).alias("n"))

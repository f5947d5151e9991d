"""Reading with a ledger of rejects, and runs behind commit records."""

import pytest
from conftest import rows
from pyspark.sql import Observation
from pyspark.sql import functions as F

from panelspark.sources import checked, runs

COLUMNS = ["geo", "TIME_PERIOD", "OBS_VALUE"]


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.csv").write_text(
        "﻿geo,TIME_PERIOD,Sex,sex,OBS_VALUE\r\nES,2000-Q1,Total,T,1.5\r\n\r\n"
        'ES,2000-Q2,"a, ""quoted"" label",T,NA\r\nES,,x,T,3\r\nES,2000-Q3,x,T\r\nES,2000-Q4,x,T,abc\r\n')
    (tmp_path / "b.csv").write_text(
        "OBS_VALUE,geo,TIME_PERIOD\n7,FR,2001-Q1\n8,FR,2001-Q2,extra\n,FR,2001-Q3\nOBS_VALUE,geo,TIME_PERIOD\n7,FR,2001-Q1\n")
    (tmp_path / "c.csv").write_text("geo,period,OBS_VALUE\nIT,2000-Q1,1\n")
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_text("TIME_PERIOD,OBS_VALUE,geo\n")
    return str(tmp_path)


def test_every_file_by_its_own_header_and_planted_faults(spark, folder):
    seen = Observation()
    good, ledger = checked.read_checked(spark, folder, COLUMNS, "TIME_PERIOD", types={"OBS_VALUE": "double"}, observation=seen)
    got = sorted((tuple(r) for r in good.collect()), key=lambda r: r[:2])
    assert got == [("ES", "2000-Q1", 1.5), ("ES", "2000-Q2", None), ("ES", "2000-Q4", None),
                   ("FR", "2001-Q1", 7.0), ("FR", "2001-Q1", 7.0), ("FR", "2001-Q3", None)]
    assert seen.get == {"lines": 10, "dropped": 4, "lost": 1}
    found = [(r["file"][-5:], r["line"], r["reason"], r["column"], r["kept"]) for r in rows(ledger, "file", "line")]
    assert found == [
        ("a.csv", "ES,,x,T,3", checked.NO_PERIOD, "TIME_PERIOD", False),
        ("a.csv", "ES,2000-Q3,x,T", checked.FIELD_COUNT, None, False),
        ("a.csv", "ES,2000-Q4,x,T,abc", checked.NOT_PARSED, "OBS_VALUE", True),
        ("b.csv", "8,FR,2001-Q2,extra", checked.FIELD_COUNT, None, False),
        ("c.csv", "IT,2000-Q1,1", checked.NO_COLUMN, "TIME_PERIOD", False)]
    assert {(r["file"][-5:], r["reason"]): r["n"] for r in rows(checked.count_rejects(ledger))}["b.csv", checked.FIELD_COUNT] == 1


def test_quotes_codes_beside_labels_and_no_types(spark, folder):
    good, ledger = checked.read_checked(spark, f"{folder}/a.csv", ["sex", "Sex", "TIME_PERIOD"], "TIME_PERIOD")
    assert {tuple(r) for r in good.collect()} == {("T", "Total", "2000-Q1"), ("T", 'a, "quoted" label', "2000-Q2"), ("T", "x", "2000-Q4")}
    assert ledger.filter("kept").count() == 0
    good, ledger = checked.read_checked(spark, f"{folder}/d.csv", COLUMNS, "TIME_PERIOD")
    assert good.columns == COLUMNS and good.count() == 0 and ledger.count() == 0


def _draws(spark, run, value, n):
    return spark.range(n).select(F.lit(run).alias("run"), F.lit("alpha").alias("param"), F.lit(0).alias("chain"),
                                 F.col("id").alias("iter"), F.lit(value).cast("double").alias("value"))


def _seen(spark, path, **kw):
    return {(r["run"], r["value"], r["n"]) for r in runs.read_committed(spark, path, **kw).groupBy("run", "value").agg(F.count("*").alias("n")).collect()}


def test_a_killed_rewrite_leaves_the_old_run(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert runs.current_runs(spark, path).count() == 0
    runs.commit_draws(_draws(spark, "a", 1, 50).union(_draws(spark, "b", 1, 5)), path)
    broken = _draws(spark, "a", 2, 400).repartition(8, "iter").withColumn(
        "value", F.when(F.col("iter") == 399, F.raise_error(F.lit("killed")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="killed"):
        runs.commit_draws(broken, path)
    runs.stage_draws(_draws(spark, "a", 3, 7), path)    # written to its end, never committed
    assert _seen(spark, path) == {("a", 1.0, 50), ("b", 1.0, 5)}
    runs.commit_draws(_draws(spark, "a", 4, 6).union(_draws(spark, None, 4, 2)), path)
    assert _seen(spark, path) == {("a", 4.0, 6), ("b", 1.0, 5), (None, 4.0, 2)} and _seen(spark, path, run="b") == {("b", 1.0, 5)}
    assert runs.damaged_runs(spark, path).count() == 0
    assert {(r["run"], r["version"], r["n"]) for r in runs.current_runs(spark, path).collect()} == {("a", 2, 6), ("b", 1, 5), (None, 2, 2)}


def test_rows_lost_after_the_commit_are_reported(spark, tmp_path):
    path = str(tmp_path / "runs")
    batch = runs.stage_draws(_draws(spark, "a", 1, 9), path)
    runs.commit_batch(spark, path, batch)
    _draws(spark, "a", 1, 4).drop("run").write.mode("overwrite").parquet(f"{path}/draws/batch={batch}/run=a")
    assert [(r["run"], r["n"], r["stored"]) for r in runs.damaged_runs(spark, path).collect()] == [("a", 9, 4)]


def test_sampler_columns_are_left_out(spark, tmp_path):
    path = str(tmp_path / "runs")
    runs.commit_draws(_draws(spark, "a", 1, 3).union(_draws(spark, "a", 2, 2).withColumn("param", F.lit("lp"))), path)
    assert _seen(spark, path) == {("a", 1.0, 3)} and _seen(spark, path, internals=True) == {("a", 2.0, 2)}

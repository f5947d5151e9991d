"""Ranks and quantiles by sample sort against one sort in memory, whatever the number of ranges."""

import math
import random
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import ranks
from conftest import rows


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    out = []
    for i in range(1500):      # a hot group with a third of its rows tied and a heavy tail
        v = 5.0 if i % 3 == 0 else round(rng.expovariate(1) ** 3, 2)
        out.append(("hot", i % 2, v))
    out += [("small", i % 2, float(rng.randint(0, 9))) for i in range(25)]
    out += [("one", 0, 1.5), ("zero", 0, 0.0), ("zero", 1, -0.0), ("zero", 0, -0.0), ("zero", 1, 0.0)]
    out += [(f"many{i}", 0, float(i)) for i in range(40)]
    pdf = pd.DataFrame(out, columns=["k", "c", "v"])
    return pdf, spark.createDataFrame(pdf).repartition(5)


@pytest.fixture(params=[1 << 21, 60, 7])
def ranges(request, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_PER_TASK", request.param)


def test_exact_quantiles(data, ranges):
    pdf, df = data
    probs = {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.731, "e": 1.0}
    got = {r["k"]: r for r in rows(ranks.exact_quantiles(df, ["k"], "v", probs))}
    assert set(got) == set(pdf["k"])
    for k, g in pdf.groupby("k"):
        for n, p in probs.items():
            assert got[k][n] == pytest.approx(np.quantile(g["v"], p), abs=1e-12), (k, n)


def test_ranks_and_scores(data, ranges):
    pdf, df = data
    got = ranks.with_scores(ranks.ranked(df, ["k"], "v", ["c"])).toPandas()
    g = pdf.groupby("k")["v"]
    want = pdf.assign(r=g.rank(method="average"), size=g.transform("size")).groupby(["k", "c", "v", "r", "size"]).size().reset_index(name="rows")
    total = got.groupby(["k", "c", "v"]).agg(n=("n", "sum"), rank=("rank", "min"), top=("rank", "max"), z=("z", "min"), all=("n_all", "max")).reset_index()
    m = total.merge(want, on=["k", "c", "v"])
    assert len(m) == len(want) == len(total) and (m["n"] == m["rows"]).all() and (m["all"] == m["size"]).all()
    assert np.allclose(m["rank"], m["r"]) and np.allclose(m["top"], m["r"])
    z = [NormalDist().inv_cdf((r - 0.375) / (n + 0.25)) for r, n in zip(m["r"], m["size"])]
    assert np.allclose(m["z"], z, atol=1e-12)


def test_one_value_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_PER_TASK", 100)
    df = spark.range(3000).selectExpr("'g' AS k", "if(id < 500, -1.0D, if(id < 2500, 7.0D, 9.0D)) AS v", "id % 2 AS c")
    out = ranks.ranked(df, ["k"], "v", ["c"])
    assert out.count() > 20    # more than the six (value, c): the value lies in many partitions
    assert {(r["v"], r["n_before"], r["n_upto"], r["n_all"]) for r in out.collect()} == {
        (-1.0, 0, 500, 3000), (7.0, 500, 2500, 3000), (9.0, 2500, 3000, 3000)}


def test_several_counts(data, ranges):
    pdf, df = data
    got = ranks.ranked(df, ["k"], "v", counts={"n": F.lit(1), "kept": F.col("c") == 0}).toPandas()
    for k, g in pdf.groupby("k"):
        mine = got[got["k"] == k]
        for r in mine.itertuples():
            assert (r.n_before, r.n_upto, r.n_all) == ((g.v < r.v).sum(), (g.v <= r.v).sum(), len(g))
            kept = g[g.c == 0]
            assert (r.kept_before, r.kept_upto, r.kept_all) == ((kept.v < r.v).sum(), (kept.v <= r.v).sum(), len(kept))


def test_nulls_nan_and_nothing(spark):
    df = spark.createDataFrame([("a", None), ("a", 1.0), ("a", math.nan), ("a", math.nan)], "k string, v double")
    got = {(r["n_before"], r["n_upto"], r["n_all"]) for r in ranks.ranked(df, ["k"], "v").collect()}
    assert got == {(0, 1, 3), (1, 3, 3)}    # NaN is one value, the largest
    assert ranks.exact_quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0

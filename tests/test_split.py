"""Row numbers and running means in pieces must give the same answers as one big window."""

import random
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions.numeric import with_norm_ppf
from panelspark.operators import split

@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    out = []
    for i in range(1500):      # a hot group with a third of its rows tied and a heavy tail
        v = 5.0 if i % 3 == 0 else round(rng.expovariate(1) ** 3, 2)
        out.append(("hot", i * 7 % 1500, v))
    out += [("small", i, float(rng.randint(0, 9))) for i in range(25)]
    out += [("one", 0, 1.5)]
    pdf = pd.DataFrame(out, columns=["k", "i", "v"])
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_number_rows(data):
    pdf, df = data
    got = split.number_rows(df, ["k"], "i", width=64).toPandas()
    want = pdf.assign(iter=pdf.groupby("k")["i"].rank(method="first").astype("int64"))
    m = got.merge(want, on=["k", "i"])
    assert len(m) == len(pdf) and (m["iter_x"] == m["iter_y"]).all()


def test_running_mean(data):
    pdf, df = data
    got = split.running_mean(df, ["k"], "i", "v", width=64).toPandas()
    s = pdf.sort_values(["k", "i"])
    want = s.assign(m=s.groupby("k")["v"].expanding().mean().to_numpy())
    m = got.merge(want, on=["k", "i"])
    assert np.allclose(m["running_mean"], m["m"])


def test_inverse_normal_against_stdlib(spark):
    ps = [1e-12, 1e-6, 0.01, 0.0749, 0.075, 0.3, 0.5, 0.6, 0.925, 0.99, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps] + [(0.0,), (1.0,)], "p double")
    got = {r["p"]: r["z"] for r in with_norm_ppf(df, F.col("p"), "z").collect()}
    assert got.pop(0.0) is None and got.pop(1.0) is None
    for p, z in got.items():
        assert z == pytest.approx(NormalDist().inv_cdf(p), rel=1e-12, abs=1e-12)

import random

from pyspark.sql import functions as F

from panelspark.operators.ordered import number_in_order


def test_places_follow_the_order_and_have_no_gaps(spark):
    rng = random.Random(1)
    values = [(i, rng.choice([None, 1.5, 1.5, 1.5, rng.random()])) for i in range(3000)]
    df = spark.createDataFrame(values, "i long, v double").repartition(7)
    got = number_in_order(df, [F.col("v").desc_nulls_last(), "i"], "at").collect()
    want = sorted(values, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r["i"], r["v"]) for r in sorted(got, key=lambda r: r["at"])] == want
    assert sorted(r["at"] for r in got) == list(range(3000))


def test_no_rows(spark):
    assert number_in_order(spark.createDataFrame([], "v double"), ["v"]).count() == 0

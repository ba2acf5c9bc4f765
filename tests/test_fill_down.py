"""Fill-down of long keys in segments, against the window form."""

import random

import pytest
from pyspark.sql import functions as F

from medspark.operators import windows


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda t: tuple((x is None, x) for x in t))


def table(spark, seed=1):
    rng, data = random.Random(seed), []
    for i in range(1500):  # a third of all rows have one key; some keys are missing, some values, one key's all
        key = rng.choice(["hot", "hot", None, *(f"k{j}" for j in range(12))])
        data.append((key, rng.choice([1, 2, None]), i, None if key == "k3" or rng.random() < .7 else float(i)))
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, j int, t int, v double").repartition(3)


@pytest.mark.parametrize("segments", [1, 4, 40])
@pytest.mark.parametrize("keys", [["k"], ["k", "j"], []])
def test_segments_equal_the_window(spark, keys, segments):
    df = table(spark)
    want = rows(windows.locf(df, "v", keys, "t", "f"), "k", "j", "t", "v", "f")
    assert rows(windows.locf_by_segments(df, "v", keys, ["t"], "f", segments), "k", "j", "t", "v", "f") == want


def test_order_of_two_columns_and_in_place(spark):
    df = table(spark, 2).withColumn("a", F.expr("t div 10")).withColumn("b", F.expr("IF(t % 10 = 0, NULL, t % 10)"))
    want = rows(windows.locf(df, "v", "k", ["a", "b"]), "k", "t", "v")
    got = windows.locf(df.withColumn("_segment", F.lit(1)), "v", "k", ["a", "b"], method="segments")
    assert got.columns == [*df.columns, "_segment"] and rows(got, "k", "t", "v") == want


def test_empty_and_all_missing(spark):
    df = table(spark).where("false")
    assert windows.locf(df, "v", "k", "t", "f", method="segments").count() == 0
    none = table(spark).withColumn("v", F.lit(None).cast("double"))
    assert windows.locf(none, "v", "k", "t", "f", method="segments").where("f IS NOT NULL").count() == 0


def test_a_hot_key_spreads_over_tasks(spark):
    """One key holds all rows: the rows of one window are those of one segment."""
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"))
    out = windows.locf_by_segments(df, "v", ["k"], ["t"], "f", 16)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_segment" in plan
    assert out.where("f <> t - t % 5").count() == 0 and out.count() == 20_000

"""Missing-value and arithmetic rules N1-N16, one case each on tiny frames."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from medspark.functions import semantics as S


def test_n1_strict_sum_is_null_when_any_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 3.0)], "g string, v double")
    out = dict(rows(df.groupBy("g").agg(S.sum_strict("v").alias("s"))))
    assert out == {"a": None, "b": 5.0}


def test_n2_na_rm_sum_of_all_missing_is_zero(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 2.0)], "g string, v double")
    out = dict(rows(df.groupBy("g").agg(S.sum_na_rm("v").alias("s"))))
    assert out == {"a": 0, "b": 2.0}


def test_n3_running_sum_stays_missing_after_first_na(spark):
    df = spark.createDataFrame([("g", 1, 1.0), ("g", 2, None), ("g", 3, 5.0)], "g string, k int, v double")
    w = Window.partitionBy("g").orderBy("k")
    out = rows(df.select("k", S.cumsum_strict("v", w).alias("c")))
    assert out == [(1, 1.0), (2, None), (3, None)]


def test_n4_sql_sum_skips_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "v double")
    assert df.agg(S.sum_sql("v")).first()[0] == 1.0


def test_n5_null_safe_join_matches_na_to_na(spark):
    from medspark.operators.joins import join_left
    left = spark.createDataFrame([(1, None), (2, "x")], "id int, k string")
    right = spark.createDataFrame([(None, "missing-area"), ("x", "area-x")], "k string, name string")
    assert rows(join_left(left, right, "k", null_safe=True), "id", "name") == [(1, "missing-area"), (2, "area-x")]
    assert rows(join_left(left, right, "k", null_safe=False), "id", "name") == [(1, None), (2, "area-x")]


def test_n6_division_by_zero_gives_null_not_error(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(S.safe_div("a", "b")).collect()] == [None, None, 1.5]


def test_n7_dense_rank_leaves_missing_unranked(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", None), ("c", 3.0), ("d", 1.0)], "g string, t double")
    w = Window.orderBy(F.col("t").desc_nulls_last())
    out = dict(rows(df.select("g", S.dense_rank_na_last(w, "t").alias("r"))))
    assert out == {"a": 1, "c": 1, "d": 2, "b": None}


def test_n8_first_by_order_is_deterministic(spark):
    df = spark.createDataFrame([("g", 3, "late"), ("g", 1, "early"), ("g", 2, None)], "g string, o int, v string")
    assert df.groupBy("g").agg(S.first_by("v", "o")).first()[1] == "early"


def test_n9_filter_drops_rows_whose_predicate_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    assert df.where(F.col("v") > 0).count() == 2


def test_n10_round_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (0.125,)], "v double")
    assert [r[0] for r in df.select(S.round_half_even("v", 0)).collect()][:3] == [0.0, 2.0, 2.0]


def test_n11_not_in_treats_na_as_a_value(spark):
    from medspark.operators.codelists import not_in_codelist
    df = spark.createDataFrame([("a",), (None,), ("b",)], "c string")
    known = spark.createDataFrame([("a",)], "c string")
    assert rows(not_in_codelist(df, "c", known)) == [("b",), (None,)]
    known_na = spark.createDataFrame([("a",), (None,)], "c string")
    assert rows(not_in_codelist(df, "c", known_na)) == [("b",)]


def test_n12_blank_and_na_text_are_missing(spark, tmpdir_path):
    from medspark.sources.readers import read_csv
    p = f"{tmpdir_path}/f.csv"
    with open(p, "w") as f:
        f.write('id,nm\n"1","NA"\n"2",""\n"3","x"\n')
    df = read_csv(spark, p, "id string, nm string")
    assert rows(df) == [("1", None), ("2", None), ("3", "x")]
    kept = read_csv(spark, p, "id string, nm string", blank_is_missing=False)
    assert dict(rows(kept))["2"] == ""
    with open(p, "w") as f:
        f.write("id,nm,n\n1,NA,1.5\n2,,NA\n3,x,\n")
    kept = read_csv(spark, p, "id string, nm string, n double", blank_is_missing=False)
    assert rows(kept) == [("1", None, 1.5), ("2", "", None), ("3", "x", None)]


def test_n13_distinct_count_counts_na_once(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "c string")
    assert df.agg(S.count_distinct_na("c")).first()[0] == 3


def test_n14_exact_percentile_is_linear_interpolation(spark):
    from medspark.operators.quality import percentiles_by
    df = spark.createDataFrame([("m", float(v)) for v in [1, 2, 3, 4]], "g string, v double")
    out = percentiles_by(df, "g", "v", [0.1, 0.5, 0.9], ["p10", "p50", "p90"]).first()
    # R type 7: 1 + (n-1)p
    assert math.isclose(out["p10"], 1.3) and out["p50"] == 2.5 and math.isclose(out["p90"], 3.7)


def test_n15_plus_is_strict(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(F.col("a") + F.col("b")).collect()] == [None, 3.0]


def test_n16_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert [r[0] for r in df.select(S.nan_to_null("v")).collect()] == [None, 1.0]


def test_explicit_missing_label(spark):
    df = spark.createDataFrame([(None,), ("x",)], "c string")
    assert [r[0] for r in df.select(S.explicit_missing("c")).collect()] == ["(Missing)", "x"]


def test_units_sum_is_order_independent(spark):
    vals = [0.1, 0.2, 0.3, 1e6 + 0.7, -0.6]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    a = df.repartition(3).agg(F.sum(S.to_units("v"))).first()[0]
    b = df.coalesce(1).agg(F.sum(S.to_units("v"))).first()[0]
    assert a == b == sum(math.floor(v * 1e6 + 0.5) for v in vals)

"""Monthly activity, exact volumes and the reports that stand on them."""

import datetime as dt
import random
import re
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from medspark.functions import dose
from medspark.functions.semantics import exact_sum
from medspark.operators.activity import issues, monthly_activity
from medspark.plans import catalog, reports
from medspark.sources import testdata as td

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


# --- A1 -------------------------------------------------------------------------

RAW = [(dt.datetime(2021, 3, 5, 7), "O1", 1, "n1", 2.0), (dt.datetime(2021, 3, 31, 23, 59), "O1", 1, "n1", 3.5),
       (dt.datetime(2021, 4, 1), "O1", 1, "n1", 4.0), (dt.datetime(2021, 3, 9), "O1", 1, "other", -1.0),
       (dt.datetime(2021, 3, 9), None, 1, "n1", 1.0), (dt.datetime(2021, 3, 9), "O2", None, None, None),
       (dt.datetime(2021, 3, 9), "O3", 3, "n3", None), (dt.datetime(2021, 3, 9), "O3", 3, "n3", 8.0)]


def raw(spark):
    return spark.createDataFrame(RAW, "day timestamp_ntz, trust string, vmp bigint, label string, q double")


def test_monthly_activity_by_four_keys(spark):
    got = monthly_activity(raw(spark), "day", "trust", "vmp", "q", "label")
    assert got.columns == ["year_month", "ods_code", "vmp_snomed_code", "vmp_product_name", "total_quantity"]
    march, april = dt.date(2021, 3, 1), dt.date(2021, 4, 1)
    assert set(rows(got)) == {(march, "O1", 1, "n1", 5.5), (april, "O1", 1, "n1", 4.0), (march, "O1", 1, "other", -1.0),
                              (march, None, 1, "n1", 1.0), (march, "O2", None, None, None), (march, "O3", 3, "n3", 8.0)}


def test_monthly_activity_by_three_keys_and_names(spark):
    got = monthly_activity(raw(spark), "day", "trust", "vmp", F.col("q") * 2, month_out="m", org_out="o", code_out="c",
                           value_out="t")
    assert got.columns == ["m", "o", "c", "t"] and (dt.date(2021, 3, 1), "O1", 1, 9.0) in rows(got)
    assert monthly_activity(raw(spark).where("false"), "day", "trust", "vmp", "q").count() == 0


def test_issues_filter_raw_rows(spark):
    codes = spark.createDataFrame([(1,)], "code bigint")
    one = issues(raw(spark), "day", "vmp", codes=codes, codelist_col="code", period=("2021-03-01", "2021-03-01"))
    assert sorted(r["q"] for r in one.collect()) == [-1.0, 1.0, 2.0, 3.5]
    assert issues(raw(spark), "day", "vmp", codes=[3]).count() == 2
    rest = issues(raw(spark), "day", "vmp", without=codes, codelist_col="code")
    assert sorted(r["trust"] for r in rest.collect()) == ["O2", "O3", "O3"]


# --- exact sums ------------------------------------------------------------------

@pytest.mark.parametrize("na_rm", [True, False])
def test_exact_sum_beyond_64_bits(spark, na_rm):
    rng = random.Random(3)
    values = [(k, v) for k in range(4) for v in (2**63 - 1, 2**63 - 2, -5, rng.randrange(2**62, 2**63), -(2**63))]
    values += [(5, -(2**63)), (5, -(2**63)), (6, None), (6, 7), (7, None), (8, 0)]
    df = spark.createDataFrame(values, "k int, v bigint").repartition(3)
    got = {r["k"]: r["s"] for r in df.groupBy("k").agg(exact_sum("v", na_rm).alias("s")).collect()}
    want = defaultdict(list)
    for k, v in values:
        want[k].append(v)
    for k, vs in want.items():
        total = sum(v for v in vs if v is not None)
        assert got[k] == (Decimal(total) if na_rm or None not in vs else None)


def test_totals_above_64_bits_of_micro_ddd(spark):
    """9.2e18 micro-DDD are 9.2e12 doses; these are ten times as many."""
    rows_ = [(f"O{i % 3}", i % 2, 4.0e9) for i in range(24_000)]
    activity = spark.createDataFrame(rows_, "ods_code string, vmp_code int, quantity double")
    factors = spark.createDataFrame([(0, "A", 1_000_000_000), (1, "B", 3_250_000_001)], "vmp_code int, vtmnm string, factor bigint")
    want = {"A": 12_000 * 4 * 10**9 * 10**6, "B": 12_000 * 4 * 10**9 * 3_250_000_001 // 1000}
    assert want["A"] > 2**63 - 1
    for na_rm in (True, False):
        for first in (True, False):
            got = reports.dose_volume(activity, factors, [], na_rm=na_rm, join_first=first)
            assert {r["vtmnm"]: int(r["volume_units"]) for r in got.collect()} == want
    shares = reports.category_shares(
        reports.dose_volume(activity.withColumn("g", F.lit(1)), factors, ["g"]), "g", "vtmnm", "volume_units")
    out = {r["vtmnm"]: r for r in shares.collect()}
    total = sum(want.values())
    assert all(int(out[m]["total"]) == total and out[m]["prop_use"] == want[m] / total for m in want)


def test_micro_ddd_truncates(spark):
    df = spark.createDataFrame([(Decimal(x),) for x in (0, 999_999, 1_000_000, -999_999, -1_000_001, 10**37)], "u decimal(38,0)")
    assert [int(r[0]) for r in df.select(dose.micro_ddd("u")).collect()] == [0, 0, 1, 0, -1, 10**31]


# --- one fact, all reports ----------------------------------------------------------

def fact(spark):
    """Row-level: activity rows with their exact volumes."""
    return td.volume(spark, SF)


def micro(df, by, na_rm):
    from medspark.functions.semantics import agg_sum
    return df.groupBy(*by, "vtmnm").agg(dose.micro_ddd(agg_sum("volume_units", na_rm)).alias("volume_units"))


@pytest.mark.parametrize("na_rm", [True, False])
@pytest.mark.parametrize("by", [["year_month"], ["vmp_code"], ["ods_code"], ["year_month", "ods_code"], []])
def test_both_plans_equal_the_fact_table(spark, by, na_rm):
    want = rows(micro(fact(spark), by, na_rm))
    for first in (True, False, None):
        got = reports.dose_volume(td.issues(spark, SF), td.factors(spark, SF), by, na_rm=na_rm, join_first=first)
        assert rows(got.select(*by, "vtmnm", "volume_units")) == want


def test_attributes_of_organisations(spark):
    areas = reports.org_areas(td.orgs(spark, SF), td.areas(spark, SF), area_overrides={1: 4})
    by = {"stp_name": F.coalesce("stp_name", F.lit("(Missing)")), "year_month": F.col("year_month")}
    want = rows(micro(reports.with_areas(fact(spark), td.orgs(spark, SF), td.areas(spark, SF), area_overrides={1: 4})
                      .withColumn("stp_name", by["stp_name"]), ["stp_name", "year_month"], True))
    for first in (True, False):
        got = reports.dose_volume(td.issues(spark, SF), td.factors(spark, SF), by, orgs=areas, na_rm=True, join_first=first)
        assert rows(got) == want


def test_reports_take_summed_activity_too(spark):
    """Any grain of activity gives the same report."""
    summed = td.activity(spark, SF).withColumnRenamed("total_quantity", "quantity")
    a, b = (rows(reports.dose_volume(x, td.factors(spark, SF), ["year_month"])) for x in (summed, td.issues(spark, SF)))
    assert a == b


def test_factors_of_a_dictionary_by_product_name(spark):
    """Q5's own joins: dictionary with a row per ingredient, DDD by product name."""
    dictionary = spark.createDataFrame([(1, "n1", "A", 2.0, 10.0, None), (2, "n2", "B", 2.0, 10.0, 4.0), (2, "n2", "C", 2.0, 6.0, None),
                                        (3, "n3", "D", 0.0, 1.0, 1.0)],
                                       "code int, name string, vtmnm string, udfs double, strnt_nmrtr_val double, strnt_dnmtr_val double")
    ddds = spark.createDataFrame([("n1", 5.0), ("n2", 0.5), ("n3", 1.0)], "nm string, ddd double")
    f = reports.product_factors(dictionary, ddds, ["code", "name"], {"name": "nm"})
    assert rows(f.select("code", "vtmnm", "factor")) == [(1, "A", 10**9), (2, "B", 5 * 10**9), (2, "C", 6 * 10**9), (3, "D", None)]
    activity = spark.createDataFrame([(1, "n1", 3.0), (2, "n2", 0.5), (2, "other", 9.0), (3, "n3", 1.0)], "code int, name string, quantity double")
    for first in (True, False):
        got = reports.dose_volume(activity, f, [], keys=["code", "name"], na_rm=False, join_first=first)
        assert {r["vtmnm"]: r["volume_units"] for r in got.collect()} == {
            "A": 3 * 10**6, "B": 2_500_000, "C": 3 * 10**6, "D": None, None: None}


def executed(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Final Plan ==")[-1].split("== Initial Plan ==")[0]


def test_national_trend_shuffles_grouped_rows_only(spark):
    plan = executed(catalog._q_national_trend(spark, SF))
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(keys) == 1 and "year_month" in keys[0] and "vtmnm" in keys[0] and "ods_code" not in plan


def test_lookups_too_large_to_broadcast_meet_sums(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = reports.dose_volume(td.issues(spark, SF), td.factors(spark, SF), ["year_month"])
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join LeftOuter") < plan.rindex("Aggregate") and plan.count("Aggregate") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

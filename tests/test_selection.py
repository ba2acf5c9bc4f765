"""Order statistics by refinement, pattern index, subtotals, two-source reports."""

import datetime as dt
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from medspark.operators import codelists, quality
from medspark.plans import catalog, reports
from medspark.sources import testdata as td

SF = "/root/testdata/sf0.001"


def quantile(values, p):
    """R type 7."""
    v = sorted(values)
    h = (len(v) - 1) * p
    lo, hi = v[math.floor(h)], v[math.ceil(h)]
    return lo + (h - math.floor(h)) * (hi - lo)


@pytest.mark.parametrize("most,cells", [(10, 8), (100_000, 1024)])
def test_percentiles_by_refinement(spark, monkeypatch, most, cells):
    """Groups of ties, skewed values, one value, none; a third of all rows in one group."""
    rng = random.Random(1)
    rows = [("hot", rng.choice([0.0, 0.0, 1.0, rng.random() ** 9])) for _ in range(700)]
    rows += [("wide", rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300)) for _ in range(300)]
    rows += [("ties", 5.0)] * 400 + [("one", -2.5)] + [("none", None)] * 3 + [(None, float(i)) for i in range(99)]
    rows += [("nan", float("nan")), ("nan", 4.0), ("inf", float("inf")), ("inf", float("-inf")), ("inf", 1.0)]
    rows += [("inf", float(i)) for i in range(60)]
    monkeypatch.setattr(quality, "SORTED_ROWS", most)
    monkeypatch.setattr(quality, "CELLS", cells)
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: list(r)[1:] for r in quality.percentiles_by(df, "g", "v", probs, [f"p{i}" for i in range(6)]).collect()}
    values = {}
    for g, v in rows:
        values.setdefault(g, [])
        if v is not None and not math.isnan(v):
            values[g].append(v)
    assert set(got) == set(values)
    for g, v in values.items():
        want = [quantile(v, p) if v else None for p in probs]
        assert all(a == b or (a is not None and math.isnan(a) and math.isnan(b)) for a, b in zip(got[g], want)), (g, got[g], want)


def test_a_round_narrows_to_the_wanted_cells(spark):
    """Ranks of a large group: no task sorts more than the limit, whatever the shape."""
    values = np.random.Generator(np.random.PCG64(4)).lognormal(0, 3, 20_000)
    df = spark.createDataFrame([(1, float(v)) for v in values], "g int, v double").repartition(4)
    ranks = spark.createDataFrame([(1, r) for r in (1, 2, 777, 10_000, 19_999, 20_000)], "g int, r bigint")
    got = {r["r"]: r["v"] for r in quality.order_statistics(df, ["g"], "v", ranks, "r", most=50, cells=16).collect()}
    ordered = np.sort(values)
    assert got == {r: float(ordered[r - 1]) for r in (1, 2, 777, 10_000, 19_999, 20_000)}


def test_deciles_need_no_global_sort(spark):
    df = catalog._q_share_deciles_long(spark, SF)
    assert "rangepartitioning" not in df._jdf.queryExecution().executedPlan().toString()


# --- patterns --------------------------------------------------------------------------

def matched(spark, names, patterns, few):
    old, codelists.FEW_PATTERNS = codelists.FEW_PATTERNS, few
    try:
        df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string").repartition(3)
        return {r["id"] for r in codelists.filter_contains_any(df, "name", patterns).collect()}
    finally:
        codelists.FEW_PATTERNS = old


@pytest.mark.parametrize("few", [0, 1000])
def test_many_patterns(spark, few):
    rng = random.Random(9)
    letters = "abcé日 %_"
    names = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, "", "ab", "ab"]
    for patterns in (["".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(60)],
                     ["é", "ab"], ["", "zzz"], ["zzzz"], [], ["abc"] * 3):
        want = {i for i, n in enumerate(names) if n is not None and any(p in n for p in patterns)}
        assert matched(spark, names, patterns, few) == want


def test_ten_thousand_patterns_are_an_equi_join(spark):
    rng = random.Random(2)
    patterns = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(10_000)]
    names = [f"x{rng.choice(patterns)}y" if i % 3 == 0 else f"name {i}" for i in range(3000)]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    out = codelists.filter_contains_any(df, "name", patterns)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "exists(" not in plan
    wanted = set(patterns)
    assert sorted(r["name"] for r in out.collect()) == sorted(n for n in names if n[1:-1] in wanted)


def test_few_patterns_are_compiled_tests(spark):
    plan = codelists.filter_contains_any(td.products(spark, SF), "vmp_name", ["red", "gear"])._jdf.queryExecution().executedPlan()
    assert "*(1) Filter" in plan.toString() and "exists(" not in plan.toString()


def test_ingredients_are_filtered_below_every_join(spark):
    plan = catalog._q_ingredient_wildcard(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Contains") > max(m.start() for m in re.finditer("Join Inner", plan)) or "Filter" in plan
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if "Contains(" in x)
    assert not any("Join" in x for x in lines[at:at + 3])


# --- subtotals ---------------------------------------------------------------------------

def test_subtotals_sum_rows_once(spark):
    df = catalog._q_subtotals(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    rows = spark.createDataFrame([("a", "x", 1, 2.0), ("a", "x", 2, 3.0), ("a", None, 1, 4.0), (None, "y", 1, None)],
                                 "p string, q string, r int, v double")
    want = {tuple(r) for r in rows.rollup("p", "q", "r").agg(F.sum("v").alias("v"), F.grouping_id().alias("grp")).collect()}
    got = [tuple(r) for r in reports.subtotals(rows, ["p", "q", "r"], "v").collect()]
    assert set(got) == want and len(got) == len(want)


# --- two sources -----------------------------------------------------------------------------

def sources(spark):
    day = dt.date(2020, 1, 1)
    hospital = spark.createDataFrame([(day, "h1", "P", 10.0), (day, "h1", "Q", 30.0), (day, "h2", "P", 5.0), (day, "h3", "P", 1.0),
                                      (day, "h4", "P", 1.0), (day, "h1", "P", 2.0)],
                                     "year_month date, ods_code string, product_name string, total_quantity double")
    orgs = spark.createDataFrame([("h1", "A"), ("h2", "B"), ("h3", None)], "ods_code string, stp_code string")
    community = spark.createDataFrame([(day, "c1", "P", 40.0), (day, "c2", "P", 20.0), (day, "c3", "Q", 7.0), (day, "c9", "Q", 7.0)],
                                      "month date, ccg_code string, product_name string, quantity double")
    ccgs = spark.createDataFrame([("c1", "A", "Area A", "R"), ("c2", "A", "Area A", "R"), ("c3", "C", None, "R"), ("c4", "B", "Area B", "S")],
                                 "ccg_code string, stp_code string, stp_name string, comm_region_name string")
    return hospital, orgs, community, ccgs


def test_combined_sources(spark):
    """B has no community issues, C no name, h3 and h4 no area: dropped."""
    got = reports.combine_sources(*sources(spark))
    assert sorted((r["stp"], r["source"], r["product_name"], r["quantity"], r["stp_name"], r["comm_region_name"])
                  for r in got.collect()) == [("A", "community", "P", 60.0, "Area A", "R"), ("A", "hospital", "P", 12.0, "Area A", "R"),
                                              ("A", "hospital", "Q", 30.0, "Area A", "R")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_area_share_is_one_sum(spark):
    rows, names = reports.source_rows(*sources(spark)), reports.area_names(sources(spark)[3])
    got = {r["stp"]: r for r in reports.area_share_by_source(rows, names, "P").collect()}
    assert set(got) == {"A", "B"}
    a, b = got["A"], got["B"]
    assert (a["community"], a["hospital"], a["total"]) == (60 / 102, 12 / 102, 60 / 102 + 12 / 102)
    assert (b["community"], b["hospital"], b["total"]) == (None, 1.0, None)
    missing = rows.unionByName(rows.limit(1).withColumn("quantity", F.lit(None).cast("double")).withColumn("stp", F.lit("A")))
    a = {r["stp"]: r for r in reports.area_share_by_source(missing, names, "P").collect()}["A"]
    assert (a["community"], a["hospital"], a["total"]) == (None, None, None)


def test_period_and_columns_reach_both_scans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        df = catalog._q_area_share_pivot(spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    for date in ("l_shipdate", "o_orderdate"):
        assert re.search(rf"PushedFilters: \[[^\]]*GreaterThanOrEqual\({date},1998-08-01", plan), date
        assert re.search(rf"PushedFilters: \[[^\]]*LessThan\({date},1999-08-01", plan), date
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"(?<!Broadcast)Exchange hashpartitioning", final)) <= 4 and "Window" not in final


def test_combined_sources_shuffle_at_most_five_times(spark):
    df = catalog._q_combined_sources(spark, SF)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    shuffles = [x for x in final.splitlines() if "Exchange hashpartitioning" in x and "ReusedExchange" not in x]
    assert len(shuffles) <= 5 and "ReusedExchange" in final and "Window" not in final


# --- distinct counts ------------------------------------------------------------------------

def test_bitmaps_count_as_distinct_does(spark):
    rng = random.Random(6)
    rows = [(dt.date(2020, 1 + i % 5, 1), rng.choice([None, 0, -1, -32768, 5, 32768, 32769, 2**40]), rng.choice([None, *range(-70000, 70000, 7)]),
             rng.choice([None, -2.0, 3.0, 0.0])) for i in range(4000)]
    df = spark.createDataFrame(rows, "m date, o bigint, p int, q double").repartition(5)
    a, b = (quality.activity_profile(df, "m", "o", "p", "q", dense_ids=x).collect() for x in (True, False))
    assert a == b and a[0]["n_ods_codes"] == 8
    some = df.where("o IS NOT NULL AND p IS NOT NULL AND q > 0")
    a, b = (quality.activity_profile(some, "m", "o", "p", "q", dense_ids=x).collect() for x in (True, False))
    assert a == b and a[0]["sum_negative"] is None
    a = quality.activity_profile(df.where("false"), "m", "o", "p", "q", dense_ids=True).collect()
    assert [tuple(r) for r in a] == [(None, None, 0, 0, None, None)]


def test_profile_copies_no_row(spark):
    assert "Expand" not in catalog._q_profile_activity(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_too_many_categories_are_an_error(spark, monkeypatch):
    from medspark.operators import reshape
    df = spark.createDataFrame([(c,) for c in ["b", None, "a", "b"]], "c string")
    assert reshape.categories_of(df, "c") == ["a", "b", None]
    monkeypatch.setattr(reshape, "MAX_CATEGORIES", 2)
    with pytest.raises(ValueError, match="column c "):
        reshape.categories_of(df, "c")

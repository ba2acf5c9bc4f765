"""Operator tests on hand-made frames: codelists, joins, organisations,
windows, calendar, reshape, quality, dictionary, dose conversion."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from medspark.functions import dose, scalars
from medspark.operators import (calendar, codelists, columns, dictionary, joins, organisations, quality,
                                reshape, windows)
from medspark.plans import reports

D = dt.date


# --- codelists -------------------------------------------------------------------

def _dmd(spark):
    products = spark.createDataFrame(
        [("100000000000000001", "Drug A 10mg", "0101"), ("100000000000000002", "Drug B", None),
         ("100000000000000003", "Combo AB", "0303")], "id string, nm string, bnf_code string")
    links = spark.createDataFrame([("100000000000000001", "1"), ("100000000000000002", "2"),
                                   ("100000000000000003", "1"), ("100000000000000003", "2")],
                                  "vmp string, ing string")
    ings = spark.createDataFrame([("1", "Alphamab"), ("2", "Betamab")], "id string, nm string")
    ddd = spark.createDataFrame([("100000000000000001", 4.5)], "vpid string, ddd double")
    return products, links, ings, ddd


def test_ingredient_lookup_exact_and_wildcard(spark):
    p, lk, ing, ddd = _dmd(spark)
    exact = codelists.ingredient_lookup(p, lk, ing, ddd, ["Alphamab"], wildcards=False)
    assert rows(exact, "id", "ingredient", "ddd") == [
        ("100000000000000001", "Alphamab", 4.5), ("100000000000000003", "Alphamab", None)]
    wild = codelists.ingredient_lookup(p, lk, ing, ddd, ["pha", "eta"], wildcards=True)
    assert wild.count() == 4  # the combination product fans out per ingredient
    assert set(r["type"] for r in wild.collect()) == {"vmp"}
    both = codelists.exact_union_wildcard(exact, wild)
    assert both.count() == 4


def test_ingredient_lookup_wildcard_needs_two_names(spark):
    p, lk, ing, ddd = _dmd(spark)
    with pytest.raises(ValueError):
        codelists.ingredient_lookup(p, lk, ing, ddd, ["pha"], wildcards=True)


def test_wildcard_is_case_sensitive_and_many_patterns_use_semi_join(spark):
    df = spark.createDataFrame([("Red gear",), ("red rod",), ("blue",)], "n string")
    assert rows(codelists.filter_contains_any(df, "n", ["red", "zz"])) == [("red rod",)]
    many = ["red"] + [f"p{i}" for i in range(100)]
    assert rows(codelists.filter_contains_any(df, "n", many)) == [("red rod",)]


def test_missing_names_and_availability_counts(spark):
    p, lk, ing, ddd = _dmd(spark)
    found = codelists.ingredient_lookup(p, lk, ing, ddd, ["Alphamab", "Gammamab"], wildcards=False)
    assert rows(codelists.missing_names(spark, ["Alphamab", "Gammamab"], found)) == [("Gammamab",)]
    counts = codelists.availability_counts(found, "ingredient", "ddd")
    assert rows(counts) == [("Alphamab", False, 1), ("Alphamab", True, 1)]
    assert codelists.nonnull_counts(found, ["id", "ddd"]).first().asDict() == {"n_id": 2, "n_ddd": 1}


def test_codelist_literal_and_table_forms_agree(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "code long")
    codes = spark.createDataFrame([(1,), (3,)], "code long")
    assert rows(codelists.in_codelist(df, "code", [1, 3])) == rows(codelists.in_codelist(df, "code", codes))


def test_eighteen_digit_ids_survive_as_text(spark, tmpdir_path):
    from medspark.sources.readers import read_csv
    p = f"{tmpdir_path}/codes.csv"
    with open(p, "w") as f:
        f.write("type,id,bnf_code,nm,ingredient,ddd\nvmp,383772001000001107,,Drug,Ing,\n")
    df = read_csv(spark, p, "type string, id string, bnf_code string, nm string, ingredient string, ddd double")
    r = df.first()
    assert r["id"] == "383772001000001107" and r["bnf_code"] is None and r["ddd"] is None


# --- joins -------------------------------------------------------------------------

def test_join_renamed_key_and_natural_join(spark):
    x = spark.createDataFrame([("c1", "Name A", 1.0), ("c2", "Name B", 2.0)], "code string, name string, q double")
    y = spark.createDataFrame([("Name A", 10.0)], "nm string, ddd double")
    out = joins.join_left(x, y, {"name": "nm"})
    assert out.columns == ["code", "name", "q", "ddd"]
    assert rows(out, "code", "ddd") == [("c1", 10.0), ("c2", None)]
    z = spark.createDataFrame([("c1", "Name A", "X")], "code string, name string, extra string")
    assert rows(joins.natural_left_join(x, z), "code", "extra") == [("c1", "X"), ("c2", None)]


def test_duplicate_keys_and_assert_unique(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert rows(joins.duplicate_keys(df, ["k"])) == [("a", 2)]
    with pytest.raises(ValueError):
        joins.assert_unique(df, ["k"])
    joins.assert_unique(df, ["k", "v"])


@pytest.mark.parametrize("n", [0, 1, 1000, 1001, 50_000])
def test_literal_tables_take_any_number_of_rows(spark, n):
    """Whole numbers fit a double column whatever the number of rows."""
    df = joins.literal_table(spark, [(f"k{i}", i, None) for i in range(n)], "k string, v double, w int")
    assert df.dtypes == [("k", "string"), ("v", "double"), ("w", "int")]
    assert df.count() == n and df.where("w IS NULL").count() == n


def test_pivot_finds_its_categories_and_rejects_unlisted_ones(spark):
    df = spark.createDataFrame([("g", "A", 0.5), ("g", "B", 0.3), ("g", None, 0.2)], "id string, c string, v double")
    assert reshape.pivot_wider(df, ["id"], "c", ["v"]).collect()[0].asDict() == {"id": "g", "A": 0.5, "B": 0.3, "NA": 0.2}
    with pytest.raises(Exception, match="unlisted category"):
        reshape.pivot_wider(df, ["id"], "c", ["v"], ["A"]).collect()


def test_strict_trends_hold_values_and_gaps(spark):
    from medspark.plans import catalog
    for name in ("national_trend", "regional_trend"):
        got = [r[-1] for r in catalog.CATALOG[name].build(spark, "/root/testdata/sf0.001").collect()]
        assert any(v is None for v in got) and any(v is not None for v in got)


# --- organisations -------------------------------------------------------------------

def test_current_plus_historic_current_wins(spark):
    cur = spark.createDataFrame([("A", "New A"), ("B", "B")], "ods_code string, ods_name string")
    old = spark.createDataFrame([("A", "Old A"), ("C", "C")], "ods_code string, ods_name string")
    assert rows(organisations.current_plus_historic(cur, old)) == [("A", "New A"), ("B", "B"), ("C", "C")]


def test_overrides_replace_only_listed_codes(spark):
    df = spark.createDataFrame([("RQ6", "Q75"), ("RXX", "QAA"), ("RNL", None)], "ods_code string, stp_code string")
    out = organisations.apply_override(df, "ods_code", "stp_code", organisations.AREA_OVERRIDES)
    assert rows(out) == [("RNL", "QHM"), ("RQ6", "QYG"), ("RXX", "QAA")]


def test_area_coverage_groups_missing_code(spark):
    reg = spark.createDataFrame([("R2", "Two", None), ("R1", "One", None), ("R3", "Three", "Q1")],
                                "ods_code string, ods_name string, stp_code string")
    areas = spark.createDataFrame([("Q1", "Area 1", "Region")], "stp_code string, stp_name string, comm_region_name string")
    out = rows(organisations.area_coverage(reg, areas), "stp_code", "n", "ods_code", "ods_name", "stp_name")
    assert out == [("Q1", 1, "R3", "Three", "Area 1"), (None, 2, "R1", "One", None)]
    listing = rows(organisations.area_listing(reg, areas))
    assert ("One", "(Missing)", "(Missing)") in listing


# Golden extract of the raw register (headerless, 24 fields) and the expected tidy values.
RAW_REGISTER = [  # invented organisations
    "T01,NORTHFIELD AND HILLSIDE NHS FOUNDATION TRUST,Y90,QZ1,A HOUSE,A ROAD,,A TOWN,,AA1 1AA,20171001,,,,,,,,,,,0,,B",
    "T02,LOWER VALE NHS FOUNDATION TRUST,Y91,QZ2,A HOUSE,A ROAD,,A TOWN,,AA1 1AA,20190401,,,,,,,,,,,0,,A",
    "T03,EASTBROOK HOSPITALS NHS FOUNDATION TRUST,Y92,QZ3,A HOUSE,A ROAD,,A TOWN,,AA1 1AA,19930401,,,,,,,,,,,0,,G",
    "RQ6,UPPER MILL AND STONY BROOK HOSPITALS NHS TRUST,Y90,Q75,A HOUSE,A ROAD,,A TOWN,,AA1 1AA,19950401,20190930,,,,,,,,,,0,,B",
    "T05,WESTLEY AND MARSH NHS AND SOCIAL CARE TRUST,Y93,QZ4,A HOUSE,A ROAD,,A TOWN,,AA1 1AA,20060401,,,,,,,,,,,0,,J",
]
TIDY = {
    "T01": ("Northfield and Hillside NHS Foundation Trust", "QZ1", D(2017, 10, 1), None),
    "T02": ("Lower Vale NHS Foundation Trust", "QZ2", D(2019, 4, 1), None),
    "T03": ("Eastbrook Hospitals NHS Foundation Trust", "QZ3", D(1993, 4, 1), None),
    "RQ6": ("Upper Mill and Stony Brook Hospitals NHS Trust", "QYG", D(1995, 4, 1), D(2019, 9, 30)),
    "T05": ("Westley and Marsh NHS And Social Care Trust", "QZ4", D(2006, 4, 1), None),
}


def test_register_cleanup_golden(spark, tmpdir_path):
    from medspark.sources.readers import read_csv_positional
    p = f"{tmpdir_path}/etr.csv"
    with open(p, "w") as f:
        f.write("\n".join(RAW_REGISTER) + "\n")
    raw = read_csv_positional(spark, p, organisations.register_names())
    tidy = organisations.tidy_register(raw)
    got = {r["ods_code"]: (r["ods_name"], r["stp_code"], r["open_date"], r["close_date"]) for r in tidy.collect()}
    assert got == TIDY
    assert "drop_1" not in tidy.columns and "contact_telephone_number" not in tidy.columns
    assert tidy.select("amended_record_indicator").first()[0] == 0


def test_register_first_four_positional_columns(spark, tmpdir_path):
    from medspark.sources.readers import read_csv_positional
    p = f"{tmpdir_path}/etr.csv"
    with open(p, "w") as f:
        f.write("\n".join(RAW_REGISTER) + "\n")
    df = read_csv_positional(spark, p, ["ods_code", "ods_name", "region_code", "stp_code"] +
                             [f"x{i}" for i in range(20)], keep=4)
    assert df.columns == ["ods_code", "ods_name", "region_code", "stp_code"] and df.count() == 5


# --- windows -------------------------------------------------------------------------

def test_category_shares_invariants(spark):
    df = spark.createDataFrame([("R1", "A", 1.0), ("R1", "B", 3.0), ("R2", "A", 2.0), ("R2", "A", 2.0),
                                ("R3", "A", 0.0)], "g string, c string, v double")
    out = reports.category_shares(df, "g", "c", "v", na_rm=True)
    got = {(r["g"], r["c"]): r for r in out.collect()}
    assert got[("R1", "A")]["prop_use"] == 0.25 and got[("R1", "B")]["pos"] == 1.0 + 3.0 / 2
    assert got[("R2", "A")]["total"] == 4.0 and got[("R2", "A")]["prop_use"] == 1.0
    assert got[("R3", "A")]["prop_use"] is None  # zero total: no division error (N6)


def test_top_n_groups_keeps_ties_and_all_rows(spark):
    df = spark.createDataFrame([("a", "x", 5.0), ("a", "y", 5.0), ("b", "x", 10.0), ("c", "x", 10.0),
                                ("d", "x", 3.0)], "g string, c string, total double")
    out = reports.top_groups(df, "g", 2)
    assert rows(out, "g", "c", "rank") == [("a", "x", 2), ("a", "y", 2), ("b", "x", 1), ("c", "x", 1)]


def test_global_row_number_and_dense_rank(spark):
    df = spark.createDataFrame([(f"k{i}", float(i % 7)) for i in range(50)], "k string, v double").repartition(5)
    rn = windows.global_row_number(df, [F.col("v").desc(), F.col("k")], "rn")
    got = [r["k"] for r in rn.orderBy("rn").collect()]
    expected = [k for k, _ in sorted([(f"k{i}", float(i % 7)) for i in range(50)], key=lambda t: (-t[1], t[0]))]
    assert got == expected and sorted(r["rn"] for r in rn.collect()) == list(range(1, 51))
    dr = windows.global_dense_rank(df, "v", "r")
    assert {r["v"]: r["r"] for r in dr.collect()} == {float(6 - i): i + 1 for i in range(7)}


def test_minmax_scale_and_locf(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 5.0)], "k string, v double")
    assert rows(windows.minmax_scale(df, "v", "s"), "k", "s") == [("a", 0.0), ("b", 0.5), ("c", 1.0)]
    ts = spark.createDataFrame([("k", 1, 1.0), ("k", 2, None), ("k", 3, None), ("k", 4, 4.0)], "g string, t int, v double")
    assert [r["v"] for r in windows.locf(ts, "v", "g", "t").orderBy("t").collect()] == [1.0, 1.0, 1.0, 4.0]


def test_fill_group_attribute_from_other_source(spark):
    df = spark.createDataFrame([("S1", None), ("S1", "Name 1"), ("S2", None)], "stp string, name string")
    assert rows(windows.fill_group_attribute(df, ["name"], "stp")) == [("S1", "Name 1"), ("S1", "Name 1"), ("S2", None)]


# --- calendar ------------------------------------------------------------------------

def _monthly(spark, data):
    return spark.createDataFrame(data, "k string, year_month date, q double")


def test_gap_fill_full_calendar_for_every_key(spark):
    df = _monthly(spark, [("a", D(2020, 1, 1), 1.0), ("a", D(2020, 4, 1), 4.0), ("b", D(2020, 2, 1), 2.0)])
    out = calendar.fill_calendar(df, "k", "year_month", "q")
    got = rows(out, "k", "year_month", "q")
    assert len(got) == 8  # 2 keys x 4 months (Jan..Apr)
    assert ("a", D(2020, 2, 1), 0.0) in got and ("b", D(2020, 4, 1), 0.0) in got
    assert sum(r[2] for r in got) == 7.0  # gap filling keeps the total
    arr = dict(rows(calendar.trend_array(df, "k", "year_month", "q", "t")))
    assert arr == {"a": [1.0, 0.0, 0.0, 4.0], "b": [0.0, 2.0, 0.0, 0.0]}


def test_gap_fill_single_month_and_month_missing_for_all_keys(spark):
    one = _monthly(spark, [("a", D(2020, 1, 1), 1.0), ("b", D(2020, 1, 1), 2.0)])
    assert calendar.fill_calendar(one, "k", "year_month", "q").count() == 2
    gap = _monthly(spark, [("a", D(2020, 1, 1), 1.0), ("b", D(2020, 3, 1), 2.0)])
    got = rows(calendar.fill_calendar(gap, "k", "year_month", "q", fill=None), "k", "year_month", "q")
    assert ("a", D(2020, 2, 1), None) in got and len(got) == 6


def test_trend_table_joins_names_before_it_fills_the_calendar(spark):
    df = spark.createDataFrame([("a", 1, "2019-01-01", 2.0), ("a", 1, "2019-03-01", 3.0), ("b", None, "2019-02-01", 4.0)],
                               "k string, p int, m string, q double").withColumn("m", F.to_date("m"))
    ks = spark.createDataFrame([("a", "A"), ("a", "AA")], "k string, k_name string")
    ps = spark.createDataFrame([(1, "one")], "p int, p_name string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        t = reports.trend_table(df, ["k", "p"], "m", "q", [(ks, "k"), (ps, "p")])
        plan = t._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert t.columns == ["p", "k", "trend", "total_quantity", "many_positive_months", "k_name", "p_name"]
    assert rows(t) == rows(spark.createDataFrame(
        [(1, "a", [2.0, 0.0, 3.0], 5.0, False, "A", "one"), (1, "a", [2.0, 0.0, 3.0], 5.0, False, "AA", "one"),
         (None, "b", [0.0, 4.0, 0.0], 4.0, False, None, None)], t.schema))
    assert plan.count("Join") == 2
    assert plan.rindex("array_repeat") < plan.index("Join")  # rows of the joins hold the observed months alone


def test_trend_table_totals_and_flags(spark):
    data = [("a", D(2020, m, 1), float(m)) for m in range(1, 13)] + [("b", D(2020, 5, 1), -1.0)]
    df = spark.createDataFrame(data, "k string, year_month date, q double")
    out = {r["k"]: r for r in reports.trend_table(df, ["k"], "year_month", "q").collect()}
    assert out["a"]["total_quantity"] == 78.0 and out["a"]["many_positive_months"] is True
    assert out["b"]["trend"][4] == -1.0 and out["b"]["many_positive_months"] is False
    lst = dict(rows(calendar.ordered_list(df.where("k = 'a'"), "k", "year_month", "q", "l")))
    assert lst["a"] == [float(m) for m in range(1, 13)]


# --- reshape -------------------------------------------------------------------------

def test_pivot_then_unpivot_returns_input(spark):
    df = spark.createDataFrame([("s1", "community", 0.2), ("s1", "hospital", 0.3), ("s2", "hospital", 0.1)],
                               "stp string, source string, p double")
    wide = reshape.pivot_one(df, ["stp"], "source", "p", ["community", "hospital"])
    assert rows(wide) == [("s1", 0.2, 0.3), ("s2", None, 0.1)]
    back = reshape.unpivot_longer(wide, ["stp"], ["community", "hospital"], "source", "p").dropna()
    assert rows(back) == rows(df)


def test_share_table_fills_absent_cells_and_rounds_half_even(spark):
    df = spark.createDataFrame([("S1", "A", 1.0, 0.1235, 10.0), ("S1", "B", None, None, 10.0),
                                ("S2", "B", 2.0, 1.0, 2.0)],
                               "stp_name string, vtmnm string, volume_ddd double, prop_use double, total double")
    out = {r["stp_name"]: r for r in reshape.share_table(df, "stp_name", "vtmnm", ["A", "B"]).collect()}
    assert out["S1"].asDict() == {"stp_name": "S1", "prop_use_A": 0.124, "prop_use_B": 0.0, "total": 10.0}
    assert out["S2"]["prop_use_A"] == 0.0


# --- quality --------------------------------------------------------------------------

def test_activity_profile_and_flags(spark):
    df = spark.createDataFrame([(D(2020, 1, 1), "o1", "p1", 5.0), (D(2020, 2, 1), None, "p1", -2.0),
                                (D(2020, 2, 1), "o2", "p2", None)], "ym date, org string, prod string, q double")
    r = quality.activity_profile(df, "ym", "org", "prod", "q").first()
    assert (r["first_month"], r["last_month"], r["n_ods_codes"], r["n_products"]) == (D(2020, 1, 1), D(2020, 2, 1), 3, 2)
    assert (r["sum_positive"], r["sum_negative"]) == (5.0, -2.0)
    avail = quality.availability_table(spark.createDataFrame([("p1", None)], "prod string, ddd double"), "prod", "ddd", "ddd_avail")
    flagged = rows(quality.totals_with_flags(df, "prod", "q", avail, "ddd_avail"))
    assert flagged == [("p1", 3.0, "FALSE", "Positive"), ("p2", 0.0, "(Missing)", "Positive")]
    neg = rows(quality.negative_profile(df, "prod", "q"))
    assert neg[0] == ("p1", 2, 1, 0.5)


def test_column_summary_long_form(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, 2.0)], "a double, b double")
    got = {r["column"]: r for r in quality.column_summary(df, ["a", "b"]).collect()}
    assert got["a"]["mean"] == 2.0 and got["b"]["n_missing"] == 1 and got["b"]["n"] == 1


# --- dictionary, dose, scalars -------------------------------------------------------------

def test_star_join_skips_unrequested_lookups(spark):
    vmp = spark.createDataFrame([(1, "P", 10, 20)], "id long, nm string, u1 int, u2 int")
    uom = spark.createDataFrame([(10, "mg"), (20, "ml")], "cd int, descr string")
    lookups = [dictionary.Lookup("e", uom, {"a.u1": "cd"}, {"descr": "unit"}),
               dictionary.Lookup("f", uom, {"a.u2": "cd"}, {"descr": "unit2"})]
    out = dictionary.star_join(vmp, "a", {"id": "code", "nm": "name"}, lookups, cast_to_string=("code",))
    assert out.first().asDict() == {"code": "1", "name": "P", "unit": "mg", "unit2": "ml"}
    only = dictionary.star_join(vmp, "a", {"id": "code"}, lookups, columns=["code", "unit2"])
    assert only.columns == ["code", "unit2"]
    assert only._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_dose_conversion_with_and_without_denominator(spark):
    df = spark.createDataFrame([(10.0, 2.0, 100.0, None, 50.0), (10.0, 5.0, 100.0, 2.0, 50.0),
                                (10.0, 0.0, 100.0, None, 50.0)], "q double, udfs double, nmr double, dnm double, ddd double")
    out = [r[0] for r in df.select(dose.volume_ddd("q", "udfs", "nmr", "dnm", "ddd")).collect()]
    # 10/2 singles * 100 mg / 50 = 10 ; 10/5 * (100 * 5/2) / 50 = 10 ; udfs = 0 -> NULL
    assert out == [10.0, 10.0, None]


def test_scalar_helpers(spark):
    df = spark.createDataFrame([("KENT AND MEDWAY NHS AND SOCIAL CARE TRUST", "20060401", 0.1234)],
                               "n string, d string, p double")
    r = df.select(scalars.replace_first(scalars.replace_first(scalars.title_case("n"), "Nhs", "NHS"), "And", "and"),
                  scalars.parse_digits_date("d"), scalars.percent_1dp("p"), scalars.month_label(F.lit(D(2020, 3, 1))),
                  scalars.code_label("SNOMED: ", F.lit(None).cast("string")), scalars.extract_after(F.lit("prop_use_Certolizumab pegol"), "prop_use_")).first()
    assert tuple(r) == ("Kent and Medway NHS And Social Care Trust", D(2006, 4, 1), "12.3%", "Mar", "Unknown", "Certolizumab")
    assert scalars.snake_case_names(["Organisation Code", "GOR Code", "DROP_1", "Name", "Name"]) == \
        ["organisation_code", "gor_code", "drop_1", "name", "name_2"]
    bad = spark.createDataFrame([("2020-13-45",)], "d string").select(scalars.parse_digits_date("d")).first()[0]
    assert bad is None


def test_columns_helpers(spark):
    df = spark.createDataFrame([(1, 2, 3)], "prop_a int, prop_b int, other int")
    assert columns.select_prefix(df, "prop", keep=["other"]).columns == ["other", "prop_a", "prop_b"]
    assert columns.relocate(df, "other").columns[0] == "other"
    assert columns.with_constant(df, "src", None, "string").schema["src"].dataType.simpleString() == "string"
    with pytest.raises(ValueError):
        columns.require_columns(df, "missing")


# --- dm+d dictionary and the dose-volume fact ----------------------------------------------

def _dmd_tables(spark):
    vmp = spark.createDataFrame([(1001, "Drug 100mg/5ml vial", 7, 1, 5.0, 30, 31, "0101"),
                                 (1002, "Drug 50mg tablet", 7, 2, 1.0, 32, 32, None)],
                                "id long, nm string, vtm int, df_ind int, udfs double, udfs_uom int, "
                                "unit_dose_uom int, bnf_code string")
    dform = spark.createDataFrame([(1001, 1), (1002, 2)], "vmp long, form int")
    form = spark.createDataFrame([(1, "Solution for injection"), (2, "Tablet")], "cd int, descr string")
    dfind = spark.createDataFrame([(1, "Discrete"), (2, "Continuous")], "cd int, descr string")
    uom = spark.createDataFrame([(30, "ml"), (31, "vial"), (32, "tablet"), (40, "mg")], "cd int, descr string")
    vpi = spark.createDataFrame([(1001, 100.0, 40, 5.0, 30), (1002, 50.0, 40, None, None)],
                                "vmp long, strnt_nmrtr_val double, strnt_nmrtr_uom int, strnt_dnmtr_val double, "
                                "strnt_dnmtr_uom int")
    vtm = spark.createDataFrame([(7, "Drugmab")], "id int, nm string")
    bnf = spark.createDataFrame([("0101", "Drug inj")], "presentation_code string, presentation string")
    return vmp, dform, form, dfind, uom, vpi, vtm, bnf


def test_product_dictionary_star(spark):
    d = dictionary.product_dictionary(*_dmd_tables(spark))
    got = {r["vmp_snomed_code"]: r for r in d.collect()}
    assert set(got) == {"1001", "1002"}
    r = got["1001"]
    assert (r["form_descr"], r["df_descr"], r["udfs_descr"], r["unit_dose_descr"], r["strnt_nmrtr_uom"],
            r["strnt_dnmtr_descr"], r["vtmnm"], r["bnf_presentation"]) == (
        "Solution for injection", "Discrete", "ml", "vial", "mg", "ml", "Drugmab", "Drug inj")
    assert got["1002"]["strnt_dnmtr_descr"] is None and got["1002"]["bnf_presentation"] is None
    small = dictionary.product_dictionary(*_dmd_tables(spark), columns=["vmp_snomed_code", "vtmnm"])
    assert small.columns == ["vmp_snomed_code", "vtmnm"]


def test_dose_volume_fact_by_name_and_by_moiety(spark):
    d = dictionary.product_dictionary(*_dmd_tables(spark))
    act = spark.createDataFrame([(D(2020, 1, 1), "RQ6", "1001", "Drug 100mg/5ml vial", 50.0),
                                 (D(2020, 1, 1), "RXX", "1002", "Drug 50mg tablet", 10.0)],
                                "year_month date, ods_code string, vmp_snomed_code string, "
                                "vmp_product_name string, total_quantity double")
    reg = spark.createDataFrame([("RQ6", "Royal", "Q75")], "ods_code string, ods_name string, stp_code string")
    ddds = spark.createDataFrame([("Drug 100mg/5ml vial", 20.0)], "nm string, ddd double")
    out = {r["vmp_snomed_code"]: r for r in reports.dose_volume_fact(
        act, reg, d, ddds, codes=["1001", "1002"], area_overrides=organisations.AREA_OVERRIDES).collect()}
    # 50 ml / 5 ml per vial = 10 vials; 100 mg * (5/5) each = 1000 mg; / 20 mg per DDD = 50 DDD
    assert out["1001"]["volume_singles"] == 10.0 and out["1001"]["volume_ddd"] == 50.0
    assert out["1001"]["stp_code"] == "QYG" and out["1002"]["ods_name"] is None
    assert out["1002"]["volume_mg_strength"] == 500.0 and out["1002"]["volume_ddd"] is None
    by_moiety = reports.dose_volume_fact(act, reg, d, dose.moiety_ddd_table(spark, [("Drugmab", 10.0)]),
                                         ddd_by="vtmnm", ddd_col="mg_per_ddd")
    assert {r["vmp_snomed_code"]: r["volume_ddd"] for r in by_moiety.collect()} == {"1001": 100.0, "1002": 50.0}
    view = reports.dictionary_view(d, ["1001"], "vmp_snomed_code", ["vmp_snomed_code", "vtmnm", "udfs"])
    assert rows(view) == [("1001", "Drugmab", 5.0)]


def test_subtotals_rollup_levels(spark):
    df = spark.createDataFrame([("t1", "p1", 1.0), ("t1", "p2", 2.0), ("t2", "p1", 4.0)], "t string, p string, q double")
    got = {(r["t"], r["p"]): (r["q"], r["grp"]) for r in reports.subtotals(df, ["t", "p"], "q").collect()}
    assert got[("t1", None)] == (3.0, 1) and got[(None, None)] == (7.0, 3) and got[("t2", "p1")] == (4.0, 0)


def test_sql_over_registered_views(spark):
    from medspark.sources import testdata as td
    td.register_views(spark, "/root/testdata/sf0.001", prefix="t_")
    sql = spark.sql("SELECT year_month, ods_code, vmp_code, SUM(total_quantity) AS total_quantity "
                    "FROM t_act WHERE vmp_code IN (1, 2, 3) GROUP BY 1, 2, 3")
    api = td.activity(spark, "/root/testdata/sf0.001").where(F.col("vmp_code").isin(1, 2, 3))
    assert rows(sql) == rows(api.select(*sql.columns))


def test_distributed_percentiles_match_buffer_and_type7(spark):
    import random
    rnd = random.Random(7)
    data = [("hot", float(rnd.randint(0, 5))) for _ in range(3000)] + \
           [(f"g{i % 7}", rnd.random() * 100) for i in range(700)] + [("one", 4.0), ("nulls", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(6)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    names = [f"p{i}" for i in range(len(probs))]
    dist = {r["g"]: r for r in quality.percentiles_by(df, "g", "v", probs, names).collect()}
    buf = {r["g"]: r for r in quality.percentiles_by(df, "g", "v", probs, names, method="buffer").collect()}
    assert set(dist) == set(buf)
    for g in dist:
        for n in names:
            a, b = dist[g][n], buf[g][n]
            assert (a is None and b is None) or abs(a - b) <= 1e-9 * max(1.0, abs(b)), (g, n, a, b)
    assert dist["one"]["p3"] == 4.0 and dist["nulls"]["p3"] is None


def test_month_partitioned_activity_prunes_partitions(spark, tmpdir_path):
    from medspark.plans.reports import in_period
    from medspark.sources import readers
    from medspark.sources import testdata as td
    path = f"{tmpdir_path}/activity"
    readers.write_parquet(td.activity(spark, "/root/testdata/sf0.001"), path)
    back = spark.read.parquet(path)
    q = in_period(back, "year_month", "1998-08-01", "1999-07-01").select("ods_code", "total_quantity")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year_month" in plan and "1998-08-01" in plan
    months = {r[0] for r in in_period(back, "year_month", "1998-08-01", "1999-07-01").select("year_month").distinct().collect()}
    assert months and all(D(1998, 8, 1) <= m <= D(1999, 7, 1) for m in months)


def test_materialised_is_read_through_and_ignores_uncommitted(spark, tmpdir_path):
    from medspark.sources import cache
    calls = []

    def build():
        calls.append(1)
        return spark.range(5).withColumnRenamed("id", "k")

    params = {"t": tmpdir_path}
    a = cache.materialised(spark, "t_range", params, build)
    b = cache.materialised(spark, "t_range", params, build)
    assert a.count() == b.count() == 5 and len(calls) == 1
    c = cache.materialised(spark, "t_range", {"t": tmpdir_path, "v": 2}, build)
    assert c.count() == 5 and len(calls) == 2          # other parameters, other key
    import os
    path = f"{cache.shared_folder(spark)}/medspark-materialised/{cache.cache_key('t_range', params)}".replace("file:", "")
    os.remove(f"{path}/_SUCCESS")                      # as if the write had not committed
    cache.materialised(spark, "t_range", params, build)
    assert len(calls) == 3


def test_window_and_aggregate_forms_agree_on_a_hot_group(spark):
    data = [("hot", float(i % 10), i % 3 == 0 and "name" or None) for i in range(3000)] + \
           [(f"g{i}", float(i), None) for i in range(20)] + [(None, 5.0, "x"), (None, None, None)]
    df = spark.createDataFrame(data, "g string, v double, nm string").repartition(8)
    for na_rm in (True, False):
        a = rows(windows.share_of_group(df, "v", "g", "p", na_rm=na_rm), "g", "v", "p")
        b = rows(windows.share_of_group(df, "v", "g", "p", na_rm=na_rm, method="aggregate"), "g", "v", "p")
        assert len(a) == len(b) and all(x[:2] == y[:2] and (x[2] == y[2] or abs(x[2] - y[2]) < 1e-12)
                                        for x, y in zip(a, b))
        ta = rows(windows.group_total(df, "v", "g", na_rm=na_rm), "g", "total")
        tb = rows(windows.group_total(df, "v", "g", na_rm=na_rm, method="aggregate"), "g", "total")
        assert [t[0] for t in ta] == [t[0] for t in tb]
    fa = rows(windows.fill_group_attribute(df, ["nm"], "g"), "g", "nm")
    fb = rows(windows.fill_group_attribute(df, ["nm"], "g", method="aggregate"), "g", "nm")
    assert fa == fb


def test_r_order_puts_missing_last(spark):
    df = spark.createDataFrame([(None,), (2,), (1,)], "v int")
    assert [r[0] for r in df.orderBy(*columns.r_order("v")).collect()] == [1, 2, None]
    assert [r[0] for r in df.orderBy(*columns.r_order("v", descending=True)).collect()] == [2, 1, None]


def test_stacked_midpoint_missing_category_last(spark):
    df = spark.createDataFrame([("g", None, 4.0), ("g", "a", 2.0)], "g string, c string, v double")
    got = {r["c"]: r["pos"] for r in windows.stacked_midpoint(df, "v", "g", "c").collect()}
    assert got == {"a": 1.0, None: 2.0 + 2.0}


def test_calendar_ignores_rows_without_month(spark):
    df = _monthly(spark, [("a", D(2020, 1, 1), 1.0), ("a", None, 9.0), ("a", D(2020, 2, 1), 2.0)])
    assert dict(rows(calendar.trend_array(df, "k", "year_month", "q", "t"))) == {"a": [1.0, 2.0]}


def test_csv_sink_and_clean_name_reader_round_trip(spark, tmpdir_path):
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType
    from medspark.sources import readers
    df = spark.createDataFrame([("100000000000000001", "", 1.5), ("100000000000000002", None, None)],
                               "id string, nm string, ddd double")
    readers.write_csv(df, f"{tmpdir_path}/out", quote_all=True)
    schema = StructType([StructField("VPID Code", StringType()), StructField("Name", StringType()),
                         StructField("DDD", DoubleType())])
    back = readers.read_csv_clean_names(spark, f"{tmpdir_path}/out", schema)
    assert back.columns == ["vpid_code", "name", "ddd"]
    assert rows(back) == [("100000000000000001", None, 1.5), ("100000000000000002", None, None)]


def test_dose_xml_reader_row_tag_sentinel_and_missing_elements(spark, tmpdir_path):
    from medspark.sources.readers import read_dose_xml
    xml = """<?xml version="1.0" encoding="UTF-8"?>
<BNF_DETAILS>
  <VMPS>
    <VMP><VPID>383772001000001107</VPID><BNF>0301011R0</BNF><ATC>R03DX05</ATC><DDD>16.0000</DDD><DDD_UOMCD>258684004</DDD_UOMCD></VMP>
    <VMP><VPID>100000000000000002</VPID><BNF>n/a</BNF><DDD>n/a</DDD></VMP>
    <VMP><VPID>100000000000000003</VPID></VMP>
  </VMPS>
  <AMPS>
    <AMP><APID>900000000000000001</APID><BNF>0301011R0AA</BNF></AMP>
  </AMPS>
</BNF_DETAILS>
"""
    p = f"{tmpdir_path}/dose.xml"
    with open(p, "w") as f:
        f.write(xml)
    got = {r["VPID"]: r for r in read_dose_xml(spark, p).collect()}
    assert set(got) == {"383772001000001107", "100000000000000002", "100000000000000003"}  # AMP rows ignored
    first = got["383772001000001107"]
    assert (first["BNF"], first["ATC"], float(first["DDD"]), first["DDD_UOMCD"]) == ("0301011R0", "R03DX05", 16.0, "258684004")
    assert got["100000000000000002"]["BNF"] is None and got["100000000000000002"]["DDD"] is None
    assert got["100000000000000003"]["ATC"] is None


def test_source_version_follows_the_files(spark, tmpdir_path):
    from medspark.sources.cache import source_version
    p = f"{tmpdir_path}/versioned"
    spark.range(5).write.parquet(p)
    first = source_version(spark, p)
    assert first == source_version(spark, p)
    spark.range(6).write.mode("append").parquet(p)
    assert source_version(spark, p) != first


def test_common_values(spark):
    a = spark.createDataFrame([("x",), ("x",), (None,), ("y",)], "c string")
    b = spark.createDataFrame([("x",), (None,), ("z",)], "c string")
    assert {r[0] for r in codelists.common_values(a, b, "c").collect()} == {"x", None}

"""Query catalogue over the driver's test tables: Spark builders + oracle SQL.

Every entry reads the test tables (through the views of
``medspark.sources.testdata``) over their whole extent.  For each query the
Spark builder and the DuckDB SQL are written next to each other with the same
output column names.

Numbers: row-level values are unrounded (both engines compute them with the
same IEEE operations).  Daily-dose volumes are summed in fixed point, exactly
(``functions.dose``), and each sum by group and moiety is cut to whole micro-DDD
(``volume_units``), so every total, share, running position and rank key is
independent of summation order, partitioning or retries; outputs divide by 1e6.
The oracles add up the volumes of single activity rows; the Spark plans convert
sums of quantities, or raw rows, whichever the planner's sizes favour.  Only results of inexact steps (means,
interpolated percentiles) are rounded, to 6 or 8 digits.

Where the source analyses use R's strict sum (N1) and that would leave nearly
every group of the mapped tables NULL (one product in five has no DDD), the
registered query says so and uses the NA-skipping variant (N2); the strict
form is registered separately (``national_trend``, ``regional_trend``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medspark.functions.scalars import (extract_after, month_label, parse_digits_date, percent_1dp,
                                        replace_first, thousands, title_case)
from medspark.functions.semantics import explicit_missing, sum_na_rm
from medspark.operators import activity, calendar, codelists, columns, dictionary, joins, organisations, quality, reshape, windows
from medspark.operators.dictionary import Lookup, star_join
from medspark.plans import reports
from medspark.sources import cache, readers
from medspark.sources import testdata as td

V = td.VIEWS_SQL.rstrip()

# --- parameters of the registered queries (user inputs, not data) ----------------
PERIOD = ("1998-08-01", "1999-07-01")              # 12 closed months (F4)
CODELIST_BRANDS = ["Brand#1", "Brand#7", "Brand#13"]  # codes picked by an attribute (F2)
EXACT_NAMES = ["gear", "anvil", "unobtainium", "sprocket"]
WILDCARD_NAMES = ["ol", "izm"]
NAME_PATTERNS = ["red", "gear", "ld b"]
TREND_INGREDIENTS = ["gizmo"]                       # codelist of the trend reports
UNNAMED_MOIETY = "MEDIUM"
MANY_PATTERNS = [a + b for a in "abcdefghij" for b in "aeiouylr"]
MOIETIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
ONE_MOIETY = "PROMO"
SHARE_MOIETY = "SMALL"
# Area and name corrections for the mapped register (the domain's own tables
# are organisations.AREA_OVERRIDES / NAME_OVERRIDES).
TD_AREA_OVERRIDES = {3: 7, 13: 7, 23: 7, 40: 2, 50: 2, 77: 11}
TD_NAME_OVERRIDES = {5: "MERGED TRUST FIVE", 8: "MERGED TRUST EIGHT"}
# Moiety -> DDD in the same unit as the strength (inline lookup, X13/S10);
# one moiety deliberately has no entry.
TD_MOIETY_DDD = [("ECONOMY", 120.0), ("LARGE", 45.0), ("MEDIUM", 60.0), ("PROMO", 7.5),
                 ("SMALL", 16.0)]


def _sql_list(values) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


AREA_CASE_SQL = ("CASE WHEN ods_code IN (3, 13, 23) THEN 7 WHEN ods_code IN (40, 50) THEN 2 "
                 "WHEN ods_code = 77 THEN 11 ELSE stp_code END")
NAME_CASE_SQL = ("CASE WHEN ods_code = 5 THEN 'MERGED TRUST FIVE' WHEN ods_code = 8 THEN 'MERGED TRUST EIGHT' "
                 "ELSE ods_name END")
# volume joined to areas through the corrected register (Spark: reports.with_areas)
VOLA_SQL = (f", reg AS (SELECT ods_code, {AREA_CASE_SQL} AS stp_code FROM orgs),\n"
            "vola AS (SELECT vol.*, reg.stp_code, areas.stp_name, areas.comm_region_name FROM vol "
            "LEFT JOIN reg ON vol.ods_code = reg.ods_code LEFT JOIN areas ON reg.stp_code = areas.stp_code)")
CODES_SQL = (", codes AS (SELECT DISTINCT links.vmp AS vmp_code FROM links JOIN ings ON ings.id = links.ing "
             f"WHERE ings.nm IN ({_sql_list(TREND_INGREDIENTS)})),\n"
             "cact AS (SELECT * FROM act WHERE vmp_code IN (SELECT vmp_code FROM codes))")


def _strict_sql(x: str) -> str:
    return f"CASE WHEN COUNT(*) = COUNT({x}) THEN SUM({x}) END"


MICRO_PER_DDD = 1e6


def _micro_sql(strict: bool) -> str:
    """Sum of the group's exact volumes in whole micro-DDD."""
    total = _strict_sql("volume_units") if strict else "COALESCE(SUM(volume_units), 0)"
    return f"CAST(({total}) // 1000000 AS BIGINT)"


@dataclass
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    about: str


# --- shared Spark sub-plans ------------------------------------------------------

def _codelist(spark, d):
    part = td.table(spark, d, "part")
    return part.where(F.col("p_partkey").isNotNull() & F.col("p_brand").isin(CODELIST_BRANDS)).select(
        F.col("p_partkey").alias("vmp_code"))


LOOKUP_COLUMNS = {"product_id": "vmp_code", "product_name": "vmp_name", "bnf_code": "bnf_code", "link_product": "vmp",
                  "link_ingredient": "ing", "ingredient_id": "id", "ingredient_name": "nm", "ddd_product": "vmp_code",
                  "ddd_value": "ddd"}


def _lookup_tables(spark, d):
    prod = td.products(spark, d)
    return prod, td.ingredient_links(spark, d), td.ingredients(spark, d), prod


def _lookup(spark, d, names, wildcards):
    return codelists.ingredient_lookup(*_lookup_tables(spark, d), names, wildcards, **LOOKUP_COLUMNS)


def _trend_codes(spark, d):
    return _lookup(spark, d, TREND_INGREDIENTS, wildcards=False).select(F.col("id").alias("vmp_code")).distinct()


def _codelist_activity(spark, d):
    return td.activity(spark, d, codes=_trend_codes(spark, d))


def _dose(spark, d, by, orgs=None, period=None, na_rm=True):
    return reports.dose_volume(td.issues(spark, d, period=period), td.factors(spark, d), by, orgs=orgs, na_rm=na_rm)


def _org_areas(spark, d):
    return reports.org_areas(td.orgs(spark, d), td.areas(spark, d), area_overrides=TD_AREA_OVERRIDES)


def _named(column: str) -> dict:
    return {column: explicit_missing(column)}


def _product_totals(spark, d):
    return td.activity(spark, d).groupBy("vmp_code").agg(F.sum("total_quantity").alias("total_quantity"))


def _named_product_totals(spark, d):
    names = td.products(spark, d).select("vmp_code", "vmp_name")
    return joins.join_left(_product_totals(spark, d), names, "vmp_code")


def _hospital(spark, d):
    prod = td.products(spark, d).select("vmp_code", F.col("vtmnm").alias("product_name"))
    return td.activity(spark, d).join(prod, "vmp_code", "left")


def _sources(spark, d, period=None):
    """Both sources' rows and the lookups of ``reports.source_rows``."""
    moiety = td.products(spark, d).select("vmp_code", F.col("vtmnm").alias("product_name"))
    hospital = td.issues(spark, d, period=period).join(moiety, "vmp_code", "left")
    return hospital, td.orgs(spark, d), td.community_issues(spark, d, period), td.ccg_map(spark, d)


def _combined(spark, d):
    return reports.combine_sources(*_sources(spark, d), hospital_value="quantity")


def _top20_areas_unrounded(spark, d, na_rm=True):
    v = _dose(spark, d, _named("stp_name"), _org_areas(spark, d), PERIOD, na_rm)
    shares = reports.category_shares(v, "stp_name", "vtmnm", value="volume_units", na_rm=na_rm, share_na_rm=True)
    return reports.top_groups(shares, "stp_name", 20)


def _round(df, digits: dict[str, int]):
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _to_ddd(df, cols=("volume_units",)):
    """Fixed-point micro-DDD columns back to DDD; ``volume_units`` becomes ``volume_ddd``."""
    out = df.withColumns({c: F.col(c).cast("double") / F.lit(MICRO_PER_DDD) for c in cols})
    return out.withColumnRenamed("volume_units", "volume_ddd")


# --- SQL fragments shared by several oracle queries --------------------------------

def _shares_sql(group: str, src: str, where: str = "", strict: bool = False, strict_outside: bool = False) -> str:
    """category shares (na_rm; ``strict``: of strict sums; ``strict_outside``: strict
    totals) of volume per group and moiety."""
    inner = _micro_sql(strict)
    w = f"PARTITION BY {group}"
    run = f"PARTITION BY {group} ORDER BY vtmnm ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    total = f"COALESCE(SUM(volume_units) OVER ({w}), 0)"
    if strict_outside:
        total = f"CASE WHEN COUNT(*) OVER ({w}) = COUNT(volume_units) OVER ({w}) THEN SUM(volume_units) OVER ({w}) END"
    return (f", s AS (SELECT {group}, vtmnm, {inner} AS volume_units FROM {src} {where} "
            f"GROUP BY {group}, vtmnm),\n"
            f"w AS (SELECT *, volume_units / NULLIF({total}, 0) AS prop_use,\n"
            f"  CASE WHEN COUNT(*) OVER ({run}) = COUNT(volume_units) OVER ({run}) "
            f"THEN SUM(volume_units) OVER ({run}) END - volume_units / 2 AS pos,\n"
            f"  {total} AS total FROM s)")


def _trust_moieties_sql(strict: bool) -> str:
    return (f", m AS (SELECT ods_code, vtmnm, {_micro_sql(strict)} AS u FROM vol WHERE year_month BETWEEN "
            f"DATE '{PERIOD[0]}' AND DATE '{PERIOD[1]}' GROUP BY 1, 2)")


SHARES_OUT_SQL = "volume_units / 1e6 AS volume_ddd, prop_use, pos / 1e6 AS pos, total / 1e6 AS total"


def _top20_areas_sql(strict: bool = False) -> str:
    return (VOLA_SQL + ",\nva AS (SELECT * EXCLUDE (stp_name), COALESCE(stp_name, '(Missing)') AS stp_name "
                       f"FROM vola WHERE year_month BETWEEN DATE '{PERIOD[0]}' AND DATE '{PERIOD[1]}')"
                       + _shares_sql("stp_name", "va", strict=strict)
                       + ",\nr AS (SELECT *, DENSE_RANK() OVER (ORDER BY total DESC) AS rank FROM w),\n"
                       "top AS (SELECT * FROM r WHERE rank <= 20)")


TOP20_AREAS_SQL_CTE = _top20_areas_sql()

COMBINED_SQL_CTE = (
    f", h AS (SELECT a.year_month AS month, o.stp_code AS stp, 'hospital' AS source, p.vtmnm AS product_name, "
    f"{_strict_sql('a.total_quantity')} AS quantity FROM act a LEFT JOIN prod p ON a.vmp_code = p.vmp_code "
    "LEFT JOIN orgs o ON a.ods_code = o.ods_code GROUP BY 1, 2, 3, 4),\n"
    "c AS (SELECT m.comm_region_name, m.stp_name, m.stp_code AS stp, cm.month, 'community' AS source, "
    f"cm.product_name, {_strict_sql('cm.quantity')} AS quantity FROM community cm "
    "LEFT JOIN ccg_map m ON cm.ccg_code = m.ccg_code GROUP BY 1, 2, 3, 4, 5, 6),\n"
    "u AS (SELECT comm_region_name, stp_name, stp, month, source, product_name, quantity FROM c UNION "
    "SELECT NULL, NULL, stp, month, source, product_name, quantity FROM h),\n"
    "f AS (SELECT MIN(comm_region_name) OVER (PARTITION BY stp) AS comm_region_name, "
    "MIN(stp_name) OVER (PARTITION BY stp) AS stp_name, stp, month, source, product_name, quantity "
    "FROM u WHERE stp IS NOT NULL),\ncombined AS (SELECT * FROM f WHERE stp_name IS NOT NULL)")


def _ingredient_sql(names, wildcards: bool) -> str:
    if wildcards:
        cond = " OR ".join(f"ings.nm LIKE '%{n}%'" for n in names)
    else:
        cond = f"ings.nm IN ({_sql_list(names)})"
    return ("SELECT 'vmp' AS type, prod.vmp_code AS id, prod.bnf_code, prod.vmp_name AS nm, ings.nm AS ingredient, "
            "d.ddd FROM prod JOIN links ON prod.vmp_code = links.vmp JOIN ings ON ings.id = links.ing "
            f"LEFT JOIN prod d ON prod.vmp_code = d.vmp_code WHERE {cond}")


# --- the catalogue -----------------------------------------------------------------

def _q_activity_monthly(spark, d):
    return td.activity(spark, d)


def _q_activity_by_name(spark, d):
    """A1 with all four keys: the product's name is a column of the raw rows."""
    names = td.products(spark, d).select(F.col("vmp_code").alias("l_partkey"), "vmp_name")
    raw = td.table(spark, d, "lineitem").join(names, "l_partkey", "left")
    return activity.monthly_activity(raw, "l_shipdate", "l_suppkey", "l_partkey", "l_quantity", "vmp_name")


def _q_codelist_semi(spark, d):
    return td.activity(spark, d, codes=_codelist(spark, d))


def _q_codelist_anti(spark, d):
    return td.activity(spark, d, without=_codelist(spark, d))


def _q_name_wildcard_any(spark, d):
    return codelists.filter_contains_any(td.products(spark, d).select("vmp_code", "vmp_name"), "vmp_name",
                                         NAME_PATTERNS)


def _q_name_wildcard_many(spark, d):
    return codelists.filter_contains_any(td.products(spark, d).select("vmp_code", "vmp_name"), "vmp_name",
                                         MANY_PATTERNS)


def _q_name_wildcard_table(spark, d):
    """Patterns held in a table: the end of a name's first word, a blank and a letter
    that depends on the product's code."""
    prod = td.products(spark, d).select("vmp_code", "vmp_name")
    first = F.element_at(F.split("vmp_name", " "), 1)
    letter = F.chr(F.lit(97) + F.col("vmp_code") % 5)
    patterns = prod.select(F.concat(F.substring(first, -2, 2), F.lit(" "), letter))
    return codelists.filter_contains_any(prod, "vmp_name", patterns)


def _q_ingredient_exact(spark, d):
    return _lookup(spark, d, EXACT_NAMES, wildcards=False)


def _q_ingredient_wildcard(spark, d):
    return _lookup(spark, d, WILDCARD_NAMES, wildcards=True)


def _q_exact_union_wildcard(spark, d):
    return codelists.exact_or_wildcard_lookup(*_lookup_tables(spark, d), EXACT_NAMES, WILDCARD_NAMES, **LOOKUP_COLUMNS)


def _q_missing_names(spark, d):
    return codelists.missing_names(spark, EXACT_NAMES, _lookup(spark, d, EXACT_NAMES, False))


def _q_ddd_availability_by_type(spark, d):
    return codelists.availability_counts(td.products(spark, d), "vtmnm", "ddd", "ddd_available", "n")


NONNULL_COLS = ["vmp_code", "vmp_name", "udfs", "nmr", "dnm", "ddd"]


def _q_nonnull_counts(spark, d):
    return codelists.nonnull_counts(td.products(spark, d), NONNULL_COLS)


def _star(spark, d):
    nation, region = td.table(spark, d, "nation"), td.table(spark, d, "region")
    lookups = [
        Lookup("n1", nation, {"a.s_nationkey": "n_nationkey"}, {"n_name": "home_nation"}),
        Lookup("r1", region, {"n1.n_regionkey": "r_regionkey"}, {"r_name": "home_region"}),
        Lookup("o", td.orgs(spark, d), {"a.s_suppkey": "ods_code"}, {"stp_code": "stp_code"}),
        Lookup("n2", nation, {"o.stp_code": "n_nationkey"}, {"n_name": "stp_name"}),
        Lookup("r2", region, {"n2.n_regionkey": "r_regionkey"}, {"r_name": "comm_region_name"}),
    ]
    return star_join(td.table(spark, d, "supplier"), "a", {"s_suppkey": "ods_code", "s_name": "ods_name"},
                     lookups, cast_to_string=("ods_code",))


STAR_SQL = (", star AS (SELECT CAST(a.s_suppkey AS VARCHAR) AS ods_code, a.s_name AS ods_name, "
            "n1.n_name AS home_nation, r1.r_name AS home_region, o.stp_code, n2.n_name AS stp_name, "
            "r2.r_name AS comm_region_name FROM supplier a "
            "LEFT JOIN nation n1 ON a.s_nationkey = n1.n_nationkey LEFT JOIN region r1 ON n1.n_regionkey = r1.r_regionkey "
            "LEFT JOIN orgs o ON a.s_suppkey = o.ods_code LEFT JOIN nation n2 ON o.stp_code = n2.n_nationkey "
            "LEFT JOIN region r2 ON n2.n_regionkey = r2.r_regionkey)")


def _q_dictionary_star(spark, d):
    return _star(spark, d)


def _q_product_dictionary(spark, d):
    """All ten joins; a product has a row for each of its ingredients."""
    part, k = td.table(spark, d, "part"), F.col("p_partkey")
    unit = td.table(spark, d, "nation").select(F.col("n_nationkey").alias("cd"), F.col("n_name").alias("descr"))
    named = td.table(spark, d, "region").select(F.col("r_regionkey").alias("cd"), F.col("r_name").alias("descr"))
    vmp = part.select(k.alias("id"), F.col("p_name").alias("nm"), F.col("p_type").alias("vtm"), (k % 3).alias("df_ind"),
                      F.col("p_size").cast("double").alias("udfs"), (k % 25).alias("udfs_uom"),
                      (k % 26).alias("unit_dose_uom"), F.col("p_brand").alias("bnf_code"))
    dform = part.where(k % 4 != 0).select(k.alias("vmp"), (k % 5).alias("form"))
    size = F.length("ing")
    vpi = td.ingredient_links(spark, d).select(
        "vmp", size.cast("double").alias("strnt_nmrtr_val"),
        F.when(size % 2 == 1, size * 0.5).alias("strnt_dnmtr_val"),
        (size % 25).alias("strnt_nmrtr_uom"), F.when(size % 2 == 1, size % 7).alias("strnt_dnmtr_uom"))
    vtm = part.select(F.col("p_type").alias("id"), F.lower("p_type").alias("nm")).distinct()
    bnf = part.where("p_brand <> 'Brand#1'").select(
        F.col("p_brand").alias("presentation_code"), F.concat(F.lit("P "), "p_brand").alias("presentation")).distinct()
    return dictionary.product_dictionary(vmp, dform, named, named, unit, vpi, vtm, bnf)


def _q_dictionary_distinct(spark, d):
    return _star(spark, d).select("stp_code", "stp_name", "comm_region_name").dropna(subset=["stp_code"]).distinct()


def _q_join_two_keys(spark, d):
    attrs = td.products(spark, d).select("vmp_code", "vmp_name", "udfs", "nmr", "dnm")
    return joins.join_left(_named_product_totals(spark, d), attrs, ["vmp_code", "vmp_name"])


def _q_join_renamed_key(spark, d):
    ddd_by_name = td.products(spark, d).groupBy(F.col("vmp_name").alias("nm")).agg(F.min("ddd").alias("ddd"))
    return joins.join_left(_named_product_totals(spark, d), ddd_by_name, {"vmp_name": "nm"})


def _q_join_natural(spark, d):
    return joins.natural_left_join(_named_product_totals(spark, d),
                                   td.products(spark, d).select("vmp_code", "vmp_name", "vtmnm"))


def _q_join_null_safe(spark, d):
    o = td.orgs(spark, d)
    per_area = o.groupBy("stp_code").agg(F.count(F.lit(1)).alias("n_orgs_in_area"))
    return joins.join_left(o, per_area, "stp_code", null_safe=True)


def _q_lookup_duplicates(spark, d):
    return joins.duplicate_keys(td.products(spark, d), ["vmp_name"], "n")


def _q_area_remap(spark, d):
    o = organisations.apply_override(td.orgs(spark, d), "ods_code", "stp_code", TD_AREA_OVERRIDES)
    return organisations.apply_override(o, "ods_code", "ods_name", TD_NAME_OVERRIDES)


def _registers(spark, d):
    s = td.table(spark, d, "supplier")
    cur = s.where(F.col("s_nationkey") < 15).select(
        F.col("s_suppkey").alias("ods_code"), F.col("s_name").alias("ods_name"), F.col("s_nationkey").alias("stp_code"))
    hist = s.where(F.col("s_nationkey") >= 10).select(
        F.col("s_suppkey").alias("ods_code"), F.lower("s_name").alias("ods_name"), F.col("s_nationkey").alias("stp_code"))
    return cur, hist


REGISTERS_SQL = (", cur AS (SELECT s_suppkey AS ods_code, s_name AS ods_name, s_nationkey AS stp_code FROM supplier "
                 "WHERE s_nationkey < 15),\nhist AS (SELECT s_suppkey AS ods_code, lower(s_name) AS ods_name, "
                 "s_nationkey AS stp_code FROM supplier WHERE s_nationkey >= 10)")


def _q_org_current_plus_historic(spark, d):
    cur, hist = _registers(spark, d)
    return organisations.current_plus_historic(cur, hist, "ods_code")


def _q_area_listing(spark, d):
    return organisations.area_listing(td.orgs(spark, d), td.areas(spark, d))


def _q_area_coverage(spark, d):
    return organisations.area_coverage(td.orgs(spark, d), td.areas(spark, d))


def _q_dose_volume(spark, d):
    return td.dose_columns(spark, d)


def _q_dose_volume_fact(spark, d):
    prod = td.products(spark, d)
    dictionary = prod.select(F.col("vmp_code").alias("vmp_snomed_code"), F.col("vmp_name").alias("vmp_product_name"),
                             "vtmnm", "udfs", F.col("nmr").alias("strnt_nmrtr_val"),
                             F.col("dnm").alias("strnt_dnmtr_val"))
    act = (td.activity(spark, d).join(prod.select("vmp_code", "vmp_name"), "vmp_code", "left")
           .withColumnsRenamed({"vmp_code": "vmp_snomed_code", "vmp_name": "vmp_product_name"}))
    ddds = prod.groupBy(F.col("vmp_name").alias("nm")).agg(F.min("ddd").alias("ddd"))
    return reports.dose_volume_fact(act, td.orgs(spark, d), dictionary, ddds, area_overrides=TD_AREA_OVERRIDES)


def _q_dictionary_view(spark, d):
    dictionary = td.products(spark, d)
    return reports.dictionary_view(dictionary, _codelist(spark, d), "vmp_code",
                                   ["vmp_code", "vtmnm", "udfs", "nmr", "dnm", "ddd"])


def _q_dose_volume_by_product(spark, d):
    return _to_ddd(_dose(spark, d, ["vmp_code"], na_rm=False))


def _q_national_trend(spark, d):
    return _to_ddd(reports.national_trend(_dose(spark, d, ["year_month"], na_rm=False), value="volume_units"))


def _q_national_trend_na_rm(spark, d):
    return _to_ddd(reports.national_trend(_dose(spark, d, ["year_month"]), value="volume_units", na_rm=True))


def _q_regional_trend(spark, d):
    v = _dose(spark, d, ["comm_region_name", "year_month"], _org_areas(spark, d), na_rm=False)
    return _to_ddd(reports.regional_trend(v, value="volume_units", na_rm=False))


SHARE_COLS = ("volume_units", "pos", "total")


def _regional_totals(spark, d, na_rm):
    v = _dose(spark, d, _named("comm_region_name"), _org_areas(spark, d), na_rm=na_rm)
    shares = reports.category_shares(v, "comm_region_name", "vtmnm", value="volume_units", na_rm=na_rm)
    return _to_ddd(shares, SHARE_COLS)


def _q_regional_totals(spark, d):
    return _regional_totals(spark, d, na_rm=True)


def _q_regional_totals_strict(spark, d):
    """Strict sums inside and outside: a missing volume leaves its region's total missing."""
    return _regional_totals(spark, d, na_rm=False)


def _q_top20_areas(spark, d):
    return _to_ddd(_top20_areas_unrounded(spark, d), SHARE_COLS)


def _q_top20_areas_mixed(spark, d):
    """Strict inner sums; shares and totals skip missing volumes."""
    return _to_ddd(_top20_areas_unrounded(spark, d, na_rm=False), SHARE_COLS)


def _q_share_table_mixed(spark, d):
    t = reshape.share_table(_top20_areas_unrounded(spark, d, na_rm=False), "stp_name", "vtmnm", MOIETIES,
                            volume="volume_units")
    return _to_ddd(t, ("total",))


def _top20_trusts(spark, d, na_rm, without=None):
    names = td.orgs(spark, d).select("ods_code", "ods_name")
    v = _dose(spark, d, ["ods_name", "ods_code"], names, PERIOD, na_rm)
    if without is not None:
        v = v.where(F.col("vtmnm") != without)
    shares = reports.category_shares(v, ["ods_name", "ods_code"], "vtmnm", value="volume_units", na_rm=na_rm)
    top = reports.top_groups(shares, ["ods_name", "ods_code"], 20)
    top = organisations.apply_override(top, "ods_code", "ods_name", TD_NAME_OVERRIDES)
    return _to_ddd(top, SHARE_COLS)


def _q_top20_trusts(spark, d):
    return _top20_trusts(spark, d, na_rm=True)


def _q_top20_trusts_strict(spark, d):
    """Trusts with a missing volume have no total and no rank (N7); of the moieties
    that have daily doses."""
    return _top20_trusts(spark, d, na_rm=False, without=ONE_MOIETY)


def _q_share_table_all_categories(spark, d):
    """Categories found in the data; one moiety's name is missing."""
    named = F.when(F.col("vtmnm") != UNNAMED_MOIETY, F.col("vtmnm"))
    t = reshape.share_table(_top20_areas_unrounded(spark, d).withColumn("vtmnm", named), "stp_name", "vtmnm",
                            volume="volume_units")
    return _to_ddd(t, ("total",))


def _q_share_table(spark, d):
    t = reshape.share_table(_top20_areas_unrounded(spark, d), "stp_name", "vtmnm", MOIETIES,
                            volume="volume_units")
    return _to_ddd(t, ("total",))


def _q_moiety_share_per_trust(spark, d):
    v = _dose(spark, d, ["ods_code"], period=PERIOD)
    return _to_ddd(reports.moiety_share(v, "ods_code", "vtmnm", ONE_MOIETY, value="volume_units", na_rm=True))


def _q_moiety_share_strict(spark, d):
    """Of the moieties whose DDD is known: strict sums have values and gaps."""
    v = _dose(spark, d, ["ods_code"], period=PERIOD, na_rm=False).where(F.col("vtmnm") != ONE_MOIETY)
    return _to_ddd(reports.moiety_share(v, "ods_code", "vtmnm", SHARE_MOIETY, value="volume_units", na_rm=False))


def _q_moiety_ddd_trend(spark, d):
    lookup = joins.literal_lookup(spark, TD_MOIETY_DDD, "vtmnm string, mg_per_ddd double")
    factors = reports.product_factors(td.products(spark, d).drop("ddd"), lookup, ["vmp_code"], "vtmnm",
                                      numerator="nmr", denominator="dnm", ddd_col="mg_per_ddd")
    return _to_ddd(reports.dose_volume(td.issues(spark, d), factors, ["year_month"], na_rm=False))


def _trend_text(df):
    return df.withColumn("trend", F.array_join(F.col("trend").cast("array<bigint>").cast("array<string>"), ","))


def _q_trend_array(spark, d):
    names = [(td.orgs(spark, d).select("ods_code", "ods_name"), "ods_code"),
             (td.products(spark, d).select("vmp_code", "vmp_name"), "vmp_code")]
    t = reports.trend_table(_codelist_activity(spark, d), ["ods_code", "vmp_code"], "year_month",
                            "total_quantity", names)
    return _trend_text(t)


def _q_trend_array_all(spark, d):
    names = [(td.orgs(spark, d).select("ods_code", "ods_name"), "ods_code"),
             (td.products(spark, d).select("vmp_code", "vmp_name"), "vmp_code")]
    t = reports.trend_table(td.activity(spark, d), ["ods_code", "vmp_code"], "year_month", "total_quantity", names)
    return _trend_text(t)


def _q_gap_fill(spark, d):
    """Organisation and moiety; ``trend_array_all`` fills organisation and product."""
    act = td.activity(spark, d).join(td.products(spark, d).select("vmp_code", "vtmnm"), "vmp_code", "left")
    monthly = act.groupBy("ods_code", "vtmnm", "year_month").agg(F.sum("total_quantity").alias("total_quantity"))
    return calendar.fill_calendar(monthly, ["ods_code", "vtmnm"], "year_month", "total_quantity", 0.0)


def _q_locf(spark, d):
    monthly = td.activity(spark, d).groupBy("ods_code", "year_month").agg(
        F.sum("total_quantity").alias("total_quantity"))
    filled = calendar.fill_calendar(monthly, ["ods_code"], "year_month", "total_quantity", None)
    return windows.locf(filled, "total_quantity", "ods_code", "year_month", "total_quantity_locf")


def _q_fill_down_events(spark, d):
    """Raw rows of few, long keys: readings taken at some events, carried on per event type."""
    reading = F.when(F.col("event_id") % 7 == 0, F.col("value")).alias("reading")
    rows = td.table(spark, d, "events").select("event_type", "ts", "event_id", reading)
    return windows.locf(rows, "reading", "event_type", ["ts", "event_id"], "reading_locf", method="segments")


def _q_subtotals(spark, d):
    a = (td.activity(spark, d).join(td.orgs(spark, d).select("ods_code", "ods_name"), "ods_code", "left")
         .join(td.products(spark, d).select("vmp_code", "vmp_name"), "vmp_code", "left"))
    return reports.subtotals(a, ["ods_name", "vmp_name"], "total_quantity")


def _q_combined_sources(spark, d):
    return _combined(spark, d)


def _q_source_share(spark, d):
    return _round(reports.source_share(_combined(spark, d)), {"prop_prescribing": 6})


def _q_area_share_pivot(spark, d):
    rows = reports.source_rows(*_sources(spark, d, PERIOD), hospital_value="quantity")
    out = reports.area_share_by_source(rows, reports.area_names(td.ccg_map(spark, d)), ONE_MOIETY)
    return _round(out, {"community": 6, "hospital": 6, "total": 6})


def _q_share_deciles_long(spark, d):
    out = reports.trust_share_deciles(_hospital(spark, d), ONE_MOIETY)
    return _round(out, {"prop_prescribing": 8})


def _q_profile_activity(spark, d):
    return quality.activity_profile(td.activity(spark, d), "year_month", "ods_code", "vmp_code", "total_quantity",
                                    dense_ids=True)


def _q_orgs_per_month(spark, d):
    return quality.distinct_per_period(td.activity(spark, d), "year_month", "ods_code", "n")


def _q_negative_profile(spark, d):
    return _round(quality.negative_profile(td.activity(spark, d), "vmp_code", "total_quantity"),
                  {"share_negative": 6})


def _ddd_file(spark, d):
    return td.products(spark, d).where(F.col("dnm").isNotNull()).select("vmp_code", "ddd")


def _q_product_totals_flagged(spark, d):
    avail = quality.availability_table(_ddd_file(spark, d), "vmp_code", "ddd", "ddd_avail")
    out = quality.totals_with_flags(td.activity(spark, d), "vmp_code", "total_quantity", avail, "ddd_avail",
                                    out="total_count")
    return joins.natural_left_join(out, td.products(spark, d).select("vmp_code", "vmp_name"))


def _q_column_summary(spark, d):
    s = quality.column_summary(td.volume(spark, d), ["total_quantity", "volume_ddd"])
    return _round(s.withColumnRenamed("column", "column_name"), {"mean": 6})


def _q_minmax_scaled(spark, d):
    return _round(windows.minmax_scale(_product_totals(spark, d), "total_quantity", "scaled"), {"scaled": 8})


def _q_label_columns(spark, d):
    nat = reports.national_trend(_dose(spark, d, ["year_month"]), value="volume_units", na_rm=True)
    nat = _to_ddd(windows.share_of_group(nat, "volume_units", "year_month", "prop", na_rm=True))
    label = F.concat(F.lit("Month: "), month_label("year_month"), F.lit(" "), F.year("year_month").cast("string"),
                     F.lit("; Volume: "), thousands("volume_ddd"), F.lit(" ("), percent_1dp("prop"),
                     F.lit("); Medication: "), F.col("vtmnm"))
    return nat.select("year_month", "vtmnm", month_label("year_month").alias("month_label"),
                      F.year("year_month").alias("year"), thousands("volume_ddd").alias("volume_label"),
                      percent_1dp("prop").alias("share_label"), label.alias("label"))


def _raw_register(spark, d):
    p = td.table(spark, d, "part")
    raw_name = F.upper(F.concat_ws(" ", "p_name", F.lit("and"), "p_type", F.lit("nhs and trust")))
    digits = F.date_format(F.date_add(F.to_date(F.lit("1995-01-01")), F.col("p_size") * 37), "yyyyMMdd")
    return p.select(F.col("p_partkey").alias("Organisation Code"), raw_name.alias("Name"),
                    digits.alias("Open Date"))


def _q_name_cleanup(spark, d):
    reg = columns.clean_names(_raw_register(spark, d))          # organisation_code, name, open_date
    reg = reg.withColumn("name", replace_first(replace_first(title_case("name"), "Nhs", "NHS"), "And", "and"))
    reg = reg.withColumn("open_date", parse_digits_date("open_date"))
    reg = reg.withColumn("open_month", F.trunc("open_date", "month"))
    return columns.rename(reg, {"organisation_code": "ods_code", "name": "ods_name"})


def _q_register_tidy(spark, d):
    """The register file as it is published: no header, all columns by position."""
    s = td.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    filled = {
        "organisation_code": F.concat(F.lit("T"), k.cast("string")),
        "name": F.upper(F.concat(F.col("s_name"), F.lit(" and vale nhs and care trust"))),
        "national_grouping": F.concat(F.lit("Y"), (k % 7).cast("string")),
        "high_level_health_geography": F.when(k % 10 != 0, F.concat(F.lit("Q"), F.col("s_nationkey").cast("string"))),
        "open_date": F.date_format(F.date_add(F.to_date(F.lit("1995-01-01")), (k % 3000).cast("int")), "yyyyMMdd"),
        "close_date": F.when(k % 4 == 0, F.lit("20200331")),
        "amended_record_indicator": F.lit("0"),
    }
    path, names = _scratch(spark, "register"), organisations.register_names()
    readers.write_csv(s.select(*[filled.get(n, F.lit(None)).cast("string").alias(n) for n in names]), path,
                      null_value="", header=False)
    raw = readers.read_csv_positional(spark, path, names)
    return organisations.tidy_register(raw, {"T1": "QX1", "T7": "QX7"}).select(
        "ods_code", "ods_name", "region_code", "stp_code", "open_date", "close_date", "amended_record_indicator")


def _q_csv_base_blanks(spark, d):
    """Blank and NA text of a file without quotes, as base R reads it."""
    k = F.col("vmp_code")
    name = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.lit("NA")).otherwise(F.col("vmp_name"))
    dose = F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.lit("NA")).otherwise(F.col("ddd").cast("string"))
    lines = td.products(spark, d).select(
        F.concat_ws(",", k.cast("string"), name, F.coalesce(dose, F.lit("NA"))).alias("value"))
    path = _scratch(spark, "lines")
    lines.write.text(path)
    return readers.read_csv(spark, path, "vmp_code bigint, vmp_name string, ddd double", header=False,
                            blank_is_missing=False)


def _q_sql_over_views(spark, d):
    td.register_views(spark, d)
    return spark.sql("SELECT act.year_month, orgs.stp_code, SUM(act.total_quantity) AS total_quantity "
                     "FROM act LEFT JOIN orgs ON act.ods_code = orgs.ods_code GROUP BY 1, 2")


def _q_product_totals_filtered(spark, d):
    avail = quality.availability_table(_ddd_file(spark, d), "vmp_code", "ddd", "ddd_avail")
    return quality.totals_with_flags(td.activity(spark, d), "vmp_code", "total_quantity", avail, "ddd_avail",
                                     filters={"ddd_avail": ["FALSE", "(Missing)"], "positive_count": ["Positive"]},
                                     out="total_count")


def _q_common_areas(spark, d):
    return codelists.common_values(td.orgs(spark, d), td.ccg_map(spark, d), "stp_code")


def _q_share_labels(spark, d):
    table = columns.drop_columns(_q_share_table(spark, d), "total")
    wide = columns.select_prefix(table, "prop_use_", keep=["stp_name"])
    shares = [c for c in wide.columns if c != "stp_name"]
    long = reshape.unpivot_longer(wide, ["stp_name"], shares, "measure", "prop_use")
    named = long.withColumn("medication", extract_after("measure", "prop_use_"))
    return columns.relocate(columns.drop_columns(named, "measure"), "medication")


def _q_category_order(spark, d):
    totals = (_dose(spark, d, _named("stp_name"), _org_areas(spark, d)).groupBy("stp_name")
              .agg(sum_na_rm("volume_units").alias("total")))
    ranked = windows.global_row_number(totals, columns.r_order("total", "stp_name", descending=[True, False]),
                                       "sort_order")
    return _to_ddd(ranked, ("total",))


def _q_trust_rank(spark, d):
    totals = _dose(spark, d, ["ods_code"]).groupBy("ods_code").agg(sum_na_rm("volume_units").alias("total"))
    return _to_ddd(windows.global_dense_rank(totals, "total", "rank", descending=True), ("total",))


def _q_head_preview(spark, d):
    return td.activity(spark, d).orderBy("vmp_code", "year_month", "ods_code").limit(100)


def _scratch(spark, kind: str) -> str:
    return f"{cache.shared_folder(spark)}/medspark-roundtrip/{kind}-{uuid.uuid4().hex}"


def _q_csv_round_trip(spark, d):
    src = td.products(spark, d).select(F.col("vmp_code").cast("string").alias("vmp_code"), "vmp_name", "bnf_code",
                                       "nmr", "dnm", "ddd")
    path = _scratch(spark, "csv")
    readers.write_csv(src, path, null_value="NA", quote_all=True)
    schema = "vmp_code string, vmp_name string, bnf_code string, nmr double, dnm double, ddd double"
    return readers.read_csv(spark, path, schema, header=True, null_value="NA")


def _q_xml_round_trip(spark, d):
    src = td.products(spark, d).select(
        F.col("vmp_code").cast("string").alias("VPID"), F.col("bnf_code").alias("BNF"), F.col("vtmnm").alias("ATC"),
        F.col("ddd").cast("decimal(18,4)").alias("DDD"),
        F.when(F.col("dnm").isNotNull(), F.lit("mg")).alias("DDD_UOMCD"))
    path = _scratch(spark, "xml")
    readers.write_xml(src, path, row_tag="VMP", root_tag="VMPS", sentinel="n/a")
    back = readers.read_dose_xml(spark, path)
    return back.withColumn("DDD", F.col("DDD").cast("double"))


def _q_materialised_lookup(spark, d):
    part = f"{d.rstrip('/')}/part.parquet"  # the lookup reads this table alone
    params = {"sf_dir": d, "names": EXACT_NAMES, "wildcards": False, "source": cache.source_version(spark, part)}
    return cache.materialised(spark, "ingredient_lookup", params, lambda: _lookup(spark, d, EXACT_NAMES, False))


CATALOG: dict[str, Query] = {
    "activity_monthly": Query(_q_activity_monthly, f"{V}\nSELECT * FROM act", "A1"),
    "activity_by_name": Query(_q_activity_by_name,
                              f"{V}\nSELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS year_month, l_suppkey AS "
                              "ods_code, l_partkey AS vmp_snomed_code, p_name AS vmp_product_name, SUM(l_quantity) AS "
                              "total_quantity FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4",
                              "A1"),
    "codelist_semi": Query(_q_codelist_semi,
                           f"{V}\nSELECT * FROM act WHERE vmp_code IN (SELECT p_partkey FROM part "
                           f"WHERE p_brand IN ({_sql_list(CODELIST_BRANDS)}))", "F1 F2 J9"),
    "codelist_anti": Query(_q_codelist_anti,
                           f"{V}\nSELECT * FROM act a WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_brand IN "
                           f"({_sql_list(CODELIST_BRANDS)}) AND p_partkey = a.vmp_code)", "F7 J8 N11"),
    "name_wildcard_any": Query(_q_name_wildcard_any,
                               f"{V}\nSELECT vmp_code, vmp_name FROM prod WHERE "
                               + " OR ".join(f"vmp_name LIKE '%{p}%'" for p in NAME_PATTERNS), "F3"),
    "name_wildcard_many": Query(_q_name_wildcard_many,
                                f"{V}\nSELECT vmp_code, vmp_name FROM prod WHERE "
                                + " OR ".join(f"vmp_name LIKE '%{p}%'" for p in MANY_PATTERNS), "F3"),
    "name_wildcard_table": Query(_q_name_wildcard_table,
                                 f"{V}, pats AS (SELECT DISTINCT right(list_extract(string_split(vmp_name, ' '), 1), 2) || "
                                 "' ' || chr(97 + CAST(vmp_code % 5 AS INTEGER)) AS p FROM prod)\nSELECT vmp_code, "
                                 "vmp_name FROM prod WHERE EXISTS (SELECT 1 FROM pats WHERE contains(vmp_name, p))", "F3"),
    "ingredient_exact": Query(_q_ingredient_exact, f"{V}\n{_ingredient_sql(EXACT_NAMES, False)}", "G1 J2 J3"),
    "ingredient_wildcard": Query(_q_ingredient_wildcard, f"{V}\n{_ingredient_sql(WILDCARD_NAMES, True)}",
                                 "G1 F3 J2 J3"),
    "exact_union_wildcard": Query(_q_exact_union_wildcard,
                                  f"{V}\n{_ingredient_sql(EXACT_NAMES, False)}\nUNION\n"
                                  f"{_ingredient_sql(WILDCARD_NAMES, True)}", "U1 G1"),
    "missing_names": Query(_q_missing_names,
                           f"{V}\nSELECT ingredient FROM (VALUES "
                           + ", ".join(f"('{n}')" for n in EXACT_NAMES)
                           + f") t(ingredient) EXCEPT SELECT ingredient FROM ({_ingredient_sql(EXACT_NAMES, False)})",
                           "U5"),
    "ddd_availability_by_type": Query(_q_ddd_availability_by_type,
                                      f"{V}\nSELECT vtmnm, ddd IS NOT NULL AS ddd_available, COUNT(*) AS n "
                                      "FROM prod GROUP BY 1, 2", "A10"),
    "nonnull_counts": Query(_q_nonnull_counts,
                            f"{V}\nSELECT " + ", ".join(f"COUNT({c}) AS n_{c}" for c in NONNULL_COLS) + " FROM prod",
                            "A11"),
    "dictionary_star": Query(_q_dictionary_star, f"{V}{STAR_SQL}\nSELECT * FROM star", "J1 P1 P2"),
    "product_dictionary": Query(_q_product_dictionary,
                                f"{V}\nSELECT CAST(p_partkey AS VARCHAR) AS vmp_snomed_code, p_name AS vmp_product_name, "
                                "p_type AS vtmid, p_partkey % 3 AS df_ind_cd, CAST(p_size AS DOUBLE) AS udfs, p_brand "
                                "AS bnf_code, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 5 END AS form_cd, "
                                "c.r_name AS form_descr, d.r_name AS df_descr, e.n_name AS udfs_descr, f.n_name AS "
                                "unit_dose_descr, CAST(length(ing) AS DOUBLE) AS strnt_nmrtr_val, CASE WHEN "
                                "length(ing) % 2 = 1 THEN length(ing) * CAST(0.5 AS DOUBLE) END AS strnt_dnmtr_val, "
                                "h.n_name AS strnt_nmrtr_uom, i.n_name AS strnt_dnmtr_descr, lower(p_type) AS vtmnm, "
                                "CASE WHEN p_brand <> 'Brand#1' THEN 'P ' || p_brand END AS bnf_presentation "
                                "FROM part LEFT JOIN region c ON p_partkey % 4 <> 0 AND c.r_regionkey = p_partkey % 5 "
                                "LEFT JOIN region d ON d.r_regionkey = p_partkey % 3 LEFT JOIN nation e ON "
                                "e.n_nationkey = p_partkey % 25 LEFT JOIN nation f ON f.n_nationkey = p_partkey % 26 "
                                "LEFT JOIN links ON links.vmp = p_partkey LEFT JOIN nation h ON h.n_nationkey = "
                                "length(ing) % 25 LEFT JOIN nation i ON length(ing) % 2 = 1 AND i.n_nationkey = "
                                "length(ing) % 7", "J1 P2"),
    "dictionary_distinct": Query(_q_dictionary_distinct,
                                 f"{V}{STAR_SQL}\nSELECT DISTINCT stp_code, stp_name, comm_region_name FROM star "
                                 "WHERE stp_code IS NOT NULL", "A12 F5"),
    "join_two_keys": Query(_q_join_two_keys,
                           f"{V}, pt AS (SELECT vmp_code, SUM(total_quantity) AS total_quantity FROM act GROUP BY 1),\n"
                           "named AS (SELECT pt.*, prod.vmp_name FROM pt LEFT JOIN prod ON pt.vmp_code = prod.vmp_code)\n"
                           "SELECT named.*, p.udfs, p.nmr, p.dnm FROM named LEFT JOIN prod p "
                           "ON named.vmp_code = p.vmp_code AND named.vmp_name = p.vmp_name", "J5"),
    "join_renamed_key": Query(_q_join_renamed_key,
                              f"{V}, pt AS (SELECT vmp_code, SUM(total_quantity) AS total_quantity FROM act GROUP BY 1),\n"
                              "named AS (SELECT pt.*, prod.vmp_name FROM pt LEFT JOIN prod ON pt.vmp_code = prod.vmp_code),\n"
                              "byname AS (SELECT vmp_name AS nm, MIN(ddd) AS ddd FROM prod GROUP BY 1)\n"
                              "SELECT named.*, byname.ddd FROM named LEFT JOIN byname ON named.vmp_name = byname.nm",
                              "J6 X13"),
    "join_natural": Query(_q_join_natural,
                          f"{V}, pt AS (SELECT vmp_code, SUM(total_quantity) AS total_quantity FROM act GROUP BY 1),\n"
                          "named AS (SELECT pt.*, prod.vmp_name FROM pt LEFT JOIN prod ON pt.vmp_code = prod.vmp_code)\n"
                          "SELECT named.*, p.vtmnm FROM named LEFT JOIN prod p ON named.vmp_code IS NOT DISTINCT FROM "
                          "p.vmp_code AND named.vmp_name IS NOT DISTINCT FROM p.vmp_name", "J7"),
    "join_null_safe": Query(_q_join_null_safe,
                            f"{V}\nSELECT o.*, c.n_orgs_in_area FROM orgs o LEFT JOIN (SELECT stp_code, COUNT(*) AS "
                            "n_orgs_in_area FROM orgs GROUP BY 1) c ON o.stp_code IS NOT DISTINCT FROM c.stp_code",
                            "J4 N5"),
    "lookup_duplicates": Query(_q_lookup_duplicates,
                               f"{V}\nSELECT vmp_name, COUNT(*) AS n FROM prod GROUP BY 1 HAVING COUNT(*) > 1", "J11"),
    "area_remap": Query(_q_area_remap,
                        f"{V}\nSELECT ods_code, {NAME_CASE_SQL} AS ods_name, {AREA_CASE_SQL} AS stp_code FROM orgs",
                        "X12 X14"),
    "org_current_plus_historic": Query(_q_org_current_plus_historic,
                                       f"{V}{REGISTERS_SQL}\nSELECT * FROM cur UNION ALL SELECT * FROM hist h "
                                       "WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE c.ods_code = h.ods_code)",
                                       "U3 U4 U6"),
    "area_listing": Query(_q_area_listing,
                          f"{V}\nSELECT ods_name, COALESCE(stp_name, '(Missing)') AS stp_name, "
                          "COALESCE(comm_region_name, '(Missing)') AS comm_region_name FROM orgs "
                          "LEFT JOIN areas ON orgs.stp_code = areas.stp_code", "Q1 X15"),
    "area_coverage": Query(_q_area_coverage,
                           f"{V}, c AS (SELECT stp_code, COUNT(*) AS n, MIN(ods_code) AS ods_code, "
                           "arg_min(ods_name, ods_code) AS ods_name FROM orgs GROUP BY stp_code)\n"
                           "SELECT c.stp_code, c.n, c.ods_code, c.ods_name, a.stp_name, a.comm_region_name FROM c "
                           "LEFT JOIN areas a ON c.stp_code IS NOT DISTINCT FROM a.stp_code", "Q2 A8 A9"),
    "dose_volume": Query(_q_dose_volume,
                         f"{V}\nSELECT act.year_month, act.ods_code, act.vmp_code, prod.vtmnm, act.total_quantity, "
                         "act.total_quantity / prod.udfs AS volume_singles, "
                         "(act.total_quantity / prod.udfs) * CASE WHEN prod.dnm IS NULL THEN prod.nmr "
                         "ELSE prod.nmr * (prod.udfs / prod.dnm) END AS volume_mg_strength, "
                         "(act.total_quantity / prod.udfs) * CASE WHEN prod.dnm IS NULL THEN prod.nmr "
                         "ELSE prod.nmr * (prod.udfs / prod.dnm) END / NULLIF(prod.ddd, 0) AS volume_ddd "
                         "FROM act LEFT JOIN prod ON act.vmp_code = prod.vmp_code", "Q5 X10 X11"),
    "dose_volume_fact": Query(_q_dose_volume_fact,
                              f"{V}, named AS (SELECT act.year_month, act.ods_code, act.vmp_code AS vmp_snomed_code, "
                              "prod.vmp_name AS vmp_product_name, act.total_quantity FROM act LEFT JOIN prod ON "
                              f"act.vmp_code = prod.vmp_code),\nreg AS (SELECT ods_code, ods_name, {AREA_CASE_SQL} AS "
                              "stp_code FROM orgs),\nbyname AS (SELECT vmp_name AS nm, MIN(ddd) AS ddd FROM prod GROUP "
                              "BY 1)\nSELECT n.*, reg.ods_name, reg.stp_code, p.vtmnm, p.udfs, p.nmr AS strnt_nmrtr_val, "
                              "p.dnm AS strnt_dnmtr_val, b.ddd, n.total_quantity / p.udfs AS volume_singles, "
                              "(n.total_quantity / p.udfs) * CASE WHEN p.dnm IS NULL THEN p.nmr ELSE p.nmr * (p.udfs / "
                              "p.dnm) END AS volume_mg_strength, (n.total_quantity / p.udfs) * CASE WHEN p.dnm IS NULL "
                              "THEN p.nmr ELSE p.nmr * (p.udfs / p.dnm) END / NULLIF(b.ddd, 0) AS volume_ddd FROM named n "
                              "LEFT JOIN reg ON n.ods_code = reg.ods_code LEFT JOIN prod p ON n.vmp_snomed_code = "
                              "p.vmp_code AND n.vmp_product_name = p.vmp_name LEFT JOIN byname b ON n.vmp_product_name = "
                              "b.nm", "Q5 J4 J5 J6 X11 X12"),
    "dictionary_view": Query(_q_dictionary_view,
                             f"{V}\nSELECT DISTINCT vmp_code, vtmnm, udfs, nmr, dnm, ddd FROM prod WHERE vmp_code IN "
                             f"(SELECT p_partkey FROM part WHERE p_brand IN ({_sql_list(CODELIST_BRANDS)}))",
                             "Q4 F1 A12 P1"),
    "dose_volume_by_product": Query(_q_dose_volume_by_product,
                                    f"{V}\nSELECT vmp_code, vtmnm, {_micro_sql(True)} / 1e6 AS volume_ddd "
                                    "FROM vol GROUP BY 1, 2", "Q5 A2 N1 (per product)"),
    "national_trend": Query(_q_national_trend,
                            f"{V}\nSELECT year_month, vtmnm, {_micro_sql(True)} / 1e6 AS volume_ddd "
                            "FROM vol GROUP BY 1, 2", "Q6 A2 N1"),
    "national_trend_na_rm": Query(_q_national_trend_na_rm,
                                  f"{V}\nSELECT year_month, vtmnm, {_micro_sql(False)} / 1e6 AS "
                                  "volume_ddd FROM vol GROUP BY 1, 2", "A16 N2"),
    "regional_trend": Query(_q_regional_trend,
                            f"{V}{VOLA_SQL}\nSELECT COALESCE(comm_region_name, '(Missing)') AS comm_region_name, "
                            f"year_month, vtmnm, {_micro_sql(True)} / 1e6 AS volume_ddd FROM vola "
                            "GROUP BY 1, 2, 3", "Q7 A3 X12 X15"),
    "regional_totals": Query(_q_regional_totals,
                             f"{V}{VOLA_SQL},\nvr AS (SELECT * EXCLUDE (comm_region_name), "
                             "COALESCE(comm_region_name, '(Missing)') AS comm_region_name FROM vola)"
                             + _shares_sql("comm_region_name", "vr")
                             + f"\nSELECT comm_region_name, vtmnm, {SHARES_OUT_SQL} FROM w",
                             "Q8 A4 W1 W2 W3 O6"),
    "regional_totals_strict": Query(_q_regional_totals_strict,
                                    f"{V}{VOLA_SQL},\nvr AS (SELECT * EXCLUDE (comm_region_name), "
                                    "COALESCE(comm_region_name, '(Missing)') AS comm_region_name FROM vola)"
                                    + _shares_sql("comm_region_name", "vr", strict=True, strict_outside=True)
                                    + f"\nSELECT comm_region_name, vtmnm, {SHARES_OUT_SQL} FROM w", "Q8 A4 N1"),
    "top20_areas": Query(_q_top20_areas,
                         f"{V}{TOP20_AREAS_SQL_CTE}\nSELECT stp_name, vtmnm, {SHARES_OUT_SQL}, rank FROM top",
                         "Q9 F4 A5 W1-W4 F9 O4"),
    "top20_areas_mixed": Query(_q_top20_areas_mixed,
                               f"{V}{_top20_areas_sql(strict=True)}\nSELECT stp_name, vtmnm, {SHARES_OUT_SQL}, rank "
                               "FROM top", "Q9 A5"),
    "share_table_mixed": Query(_q_share_table_mixed,
                               f"{V}{_top20_areas_sql(strict=True)}\nSELECT stp_name, "
                               + ", ".join(f"COALESCE(MAX(CASE WHEN vtmnm = '{m}' THEN COALESCE(round_even(prop_use, 3), "
                                           f"0) END), 0) AS prop_use_{m}" for m in MOIETIES)
                               + ", total / 1e6 AS total FROM top GROUP BY stp_name, total", "Q10 G2"),
    "top20_trusts": Query(_q_top20_trusts,
                          f"{V}, vt AS (SELECT vol.*, orgs.ods_name FROM vol LEFT JOIN orgs ON vol.ods_code = "
                          f"orgs.ods_code WHERE year_month BETWEEN DATE '{PERIOD[0]}' AND DATE '{PERIOD[1]}')"
                          + _shares_sql("ods_name, ods_code", "vt")
                          + ",\nr AS (SELECT *, DENSE_RANK() OVER (ORDER BY total DESC) AS rank FROM w)\n"
                          f"SELECT ods_code, {NAME_CASE_SQL} AS ods_name, vtmnm, {SHARES_OUT_SQL}, rank "
                          "FROM r WHERE rank <= 20", "Q11 A6 W1-W4 F9 X14"),
    "top20_trusts_strict": Query(_q_top20_trusts_strict,
                                 f"{V}, vt AS (SELECT vol.*, orgs.ods_name FROM vol LEFT JOIN orgs ON vol.ods_code = "
                                 f"orgs.ods_code WHERE year_month BETWEEN DATE '{PERIOD[0]}' AND DATE '{PERIOD[1]}')"
                                 + _shares_sql("ods_name, ods_code", "vt", f"WHERE vtmnm <> '{ONE_MOIETY}'", True, True)
                                 + ",\nr AS (SELECT *, DENSE_RANK() OVER (ORDER BY total DESC) AS rank FROM w WHERE "
                                 f"total IS NOT NULL)\nSELECT ods_code, {NAME_CASE_SQL} AS ods_name, vtmnm, "
                                 f"{SHARES_OUT_SQL}, rank FROM r WHERE rank <= 20", "Q11 A6 N1 N7"),
    "share_table": Query(_q_share_table,
                         f"{V}{TOP20_AREAS_SQL_CTE}\nSELECT stp_name, "
                         + ", ".join(f"COALESCE(MAX(CASE WHEN vtmnm = '{m}' THEN COALESCE(round_even(prop_use, 3), 0) "
                                     f"END), 0) AS prop_use_{m}" for m in MOIETIES)
                         + ", total / 1e6 AS total FROM top GROUP BY stp_name, total",
                         "Q10 G2 R1 R5 P5 X7"),
    "share_table_all_categories": Query(_q_share_table_all_categories,
                                        f"{V}{TOP20_AREAS_SQL_CTE}\nSELECT stp_name, "
                                        + ", ".join("COALESCE(MAX(CASE WHEN vtmnm = "
                                                    f"'{m}' THEN COALESCE(round_even(prop_use, 3), 0) END), 0) AS "
                                                    f"prop_use_{'NA' if m == UNNAMED_MOIETY else m}" for m in MOIETIES)
                                        + ", total / 1e6 AS total FROM top GROUP BY stp_name, total",
                                        "Q10 G2 R1"),
    "moiety_share_per_trust": Query(_q_moiety_share_per_trust,
                                    f"{V}{_trust_moieties_sql(False)}\nSELECT ods_code, CAST(SUM(u) AS BIGINT) / 1e6 AS volume_ddd, "
                                    f"SUM(CASE WHEN vtmnm = '{ONE_MOIETY}' THEN u ELSE 0 END) / NULLIF(SUM(u), 0) AS "
                                    "prop_moiety FROM m GROUP BY 1",
                                    "Q12 A7 X18"),
    "moiety_share_strict": Query(_q_moiety_share_strict,
                                 f"{V}{_trust_moieties_sql(True)}\nSELECT ods_code, CASE WHEN COUNT(*) = COUNT(u) THEN "
                                 "CAST(SUM(u) AS BIGINT) END / 1e6 AS volume_ddd, CASE WHEN COUNT(*) = COUNT(CASE WHEN "
                                 f"vtmnm = '{SHARE_MOIETY}' THEN u ELSE 0 END) THEN SUM(CASE WHEN vtmnm = "
                                 f"'{SHARE_MOIETY}' THEN u ELSE 0 END) END / NULLIF(CASE WHEN COUNT(*) = COUNT(u) THEN "
                                 f"SUM(u) END, 0) AS prop_moiety FROM m WHERE vtmnm <> '{ONE_MOIETY}' GROUP BY 1",
                                 "Q12 A7 N1"),
    "moiety_ddd_trend": Query(_q_moiety_ddd_trend,
                              f"{V}, lk AS (SELECT * FROM (VALUES "
                              + ", ".join(f"('{m}', {v})" for m, v in TD_MOIETY_DDD)
                              + ") t(vtmnm, mg_per_ddd)),\nrows AS (SELECT act.year_month, prod.vtmnm, "
                              "CAST(FLOOR(act.total_quantity * 1000 + 0.5) AS HUGEINT) * CAST(FLOOR((1.0 / prod.udfs) * CASE WHEN "
                              "prod.dnm IS NULL THEN prod.nmr ELSE prod.nmr * (prod.udfs / prod.dnm) END / "
                              "NULLIF(lk.mg_per_ddd, 0) * 1e9 + 0.5) AS HUGEINT) AS volume_units "
                              "FROM act LEFT JOIN prod ON act.vmp_code = prod.vmp_code LEFT JOIN lk "
                              f"ON prod.vtmnm = lk.vtmnm)\nSELECT year_month, vtmnm, {_micro_sql(True)} / 1e6 AS "
                              "volume_ddd FROM rows GROUP BY 1, 2",
                              "X13 S10 J4"),
    "trend_array": Query(_q_trend_array,
                         f"{V}{CODES_SQL},\nm AS (SELECT ods_code, vmp_code, year_month, SUM(total_quantity) AS q "
                         "FROM cact GROUP BY 1, 2, 3),\ncal AS (SELECT CAST(unnest(generate_series((SELECT MIN("
                         "year_month) FROM m), (SELECT MAX(year_month) FROM m), INTERVAL 1 MONTH)) AS DATE) AS "
                         "year_month),\nk AS (SELECT DISTINCT ods_code, vmp_code FROM m),\n"
                         "filled AS (SELECT k.ods_code, k.vmp_code, cal.year_month, COALESCE(m.q, 0) AS q FROM k "
                         "CROSS JOIN cal LEFT JOIN m ON m.ods_code = k.ods_code AND m.vmp_code = k.vmp_code AND "
                         "m.year_month = cal.year_month),\nt AS (SELECT ods_code, vmp_code, array_to_string(list("
                         "CAST(CAST(q AS BIGINT) AS VARCHAR) ORDER BY year_month), ',') AS trend, SUM(q) AS "
                         "total_quantity, SUM(CASE WHEN q > 0 THEN 1 ELSE 0 END) > 10 AS many_positive_months "
                         "FROM filled GROUP BY 1, 2)\nSELECT t.*, orgs.ods_name, prod.vmp_name FROM t LEFT JOIN "
                         "orgs ON t.ods_code = orgs.ods_code LEFT JOIN prod ON t.vmp_code = prod.vmp_code",
                         "Q3 R6 A18 X19 X20"),
    "trend_array_all": Query(_q_trend_array_all,
                             f"{V},\nm AS (SELECT ods_code, vmp_code, year_month, SUM(total_quantity) AS q "
                             "FROM act GROUP BY 1, 2, 3),\ncal AS (SELECT CAST(unnest(generate_series((SELECT MIN("
                             "year_month) FROM m), (SELECT MAX(year_month) FROM m), INTERVAL 1 MONTH)) AS DATE) AS "
                             "year_month),\nk AS (SELECT DISTINCT ods_code, vmp_code FROM m),\n"
                             "filled AS (SELECT k.ods_code, k.vmp_code, cal.year_month, COALESCE(m.q, 0) AS q FROM k "
                             "CROSS JOIN cal LEFT JOIN m ON m.ods_code = k.ods_code AND m.vmp_code = k.vmp_code AND "
                             "m.year_month = cal.year_month),\nt AS (SELECT ods_code, vmp_code, array_to_string(list("
                             "CAST(CAST(q AS BIGINT) AS VARCHAR) ORDER BY year_month), ',') AS trend, SUM(q) AS "
                             "total_quantity, SUM(CASE WHEN q > 0 THEN 1 ELSE 0 END) > 10 AS many_positive_months "
                             "FROM filled GROUP BY 1, 2)\nSELECT t.*, orgs.ods_name, prod.vmp_name FROM t LEFT JOIN "
                             "orgs ON t.ods_code = orgs.ods_code LEFT JOIN prod ON t.vmp_code = prod.vmp_code",
                             "Q3 R6 A18 X19 X20 (all keys)"),
    "gap_fill": Query(_q_gap_fill,
                      f"{V}, m AS (SELECT ods_code, vtmnm, year_month, SUM(total_quantity) AS q "
                      "FROM act LEFT JOIN prod ON act.vmp_code = prod.vmp_code GROUP BY 1, 2, 3),\ncal AS (SELECT CAST(unnest(generate_series((SELECT MIN("
                      "year_month) FROM m), (SELECT MAX(year_month) FROM m), INTERVAL 1 MONTH)) AS DATE) AS "
                      "year_month),\nk AS (SELECT DISTINCT ods_code, vtmnm FROM m)\n"
                      "SELECT k.ods_code, k.vtmnm, cal.year_month, COALESCE(m.q, 0) AS total_quantity FROM k "
                      "CROSS JOIN cal LEFT JOIN m ON m.ods_code = k.ods_code AND m.vtmnm = k.vtmnm AND "
                      "m.year_month = cal.year_month", "R6 J10 W6"),
    "locf": Query(_q_locf,
                  f"{V}, m AS (SELECT ods_code, year_month, SUM(total_quantity) AS q "
                  "FROM act GROUP BY 1, 2),\ncal AS (SELECT CAST(unnest(generate_series((SELECT MIN("
                  "year_month) FROM m), (SELECT MAX(year_month) FROM m), INTERVAL 1 MONTH)) AS DATE) AS "
                  "year_month),\nk AS (SELECT DISTINCT ods_code FROM m),\nfilled AS (SELECT k.ods_code, "
                  "cal.year_month, m.q AS total_quantity FROM k CROSS JOIN cal LEFT JOIN m ON m.ods_code = "
                  "k.ods_code AND m.year_month = cal.year_month)\nSELECT *, LAST_VALUE(total_quantity IGNORE NULLS) "
                  "OVER (PARTITION BY ods_code ORDER BY year_month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
                  "AS total_quantity_locf FROM filled", "W7"),
    "fill_down_events": Query(_q_fill_down_events,
                              "WITH r AS (SELECT event_type, ts, event_id, CASE WHEN event_id % 7 = 0 THEN value END AS "
                              "reading FROM events)\nSELECT *, LAST_VALUE(reading IGNORE NULLS) OVER (PARTITION BY "
                              "event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS "
                              "reading_locf FROM r", "W7"),
    "subtotals": Query(_q_subtotals,
                       f"{V}\nSELECT orgs.ods_name, prod.vmp_name, SUM(act.total_quantity) AS "
                       "total_quantity, GROUPING(orgs.ods_name, prod.vmp_name) AS grp FROM act LEFT JOIN orgs ON "
                       "act.ods_code = orgs.ods_code LEFT JOIN prod ON act.vmp_code = prod.vmp_code "
                       "GROUP BY ROLLUP (orgs.ods_name, prod.vmp_name)", "A20"),
    "combined_sources": Query(_q_combined_sources, f"{V}{COMBINED_SQL_CTE}\nSELECT * FROM combined",
                              "Q13 A22 U2 P8 F5 W5"),
    "source_share": Query(_q_source_share,
                          f"{V}{COMBINED_SQL_CTE},\nnat AS (SELECT month, source, product_name, "
                          f"{_strict_sql('quantity')} AS nat_quantity FROM combined GROUP BY 1, 2, 3),\n"
                          "nt AS (SELECT *, CASE WHEN COUNT(*) OVER (PARTITION BY month, source) = COUNT(nat_quantity) "
                          "OVER (PARTITION BY month, source) THEN SUM(nat_quantity) OVER (PARTITION BY month, source) "
                          "END AS nat_total_quantity FROM nat)\nSELECT month, source, product_name, nat_quantity, "
                          "nat_total_quantity, ROUND(nat_quantity / NULLIF(nat_total_quantity, 0), 6) AS "
                          "prop_prescribing FROM nt", "Q14 A2 W1 W2"),
    "area_share_pivot": Query(_q_area_share_pivot,
                              f"{V}{COMBINED_SQL_CTE},\nper AS (SELECT stp_name, stp, source, product_name, "
                              f"{_strict_sql('quantity')} AS stp_quantity FROM combined WHERE month BETWEEN DATE "
                              f"'{PERIOD[0]}' AND DATE '{PERIOD[1]}' GROUP BY 1, 2, 3, 4),\n"
                              "sh AS (SELECT *, stp_quantity / NULLIF(CASE WHEN COUNT(*) OVER (PARTITION BY stp) = "
                              "COUNT(stp_quantity) OVER (PARTITION BY stp) THEN SUM(stp_quantity) OVER (PARTITION BY "
                              f"stp) END, 0) AS prop FROM per),\none AS (SELECT * FROM sh WHERE product_name = "
                              f"'{ONE_MOIETY}'),\npv AS (SELECT stp_name, stp, product_name, MAX(CASE WHEN source = "
                              "'community' THEN prop END) AS community, MAX(CASE WHEN source = 'hospital' THEN prop "
                              "END) AS hospital FROM one GROUP BY 1, 2, 3)\nSELECT stp_name, stp, product_name, "
                              "ROUND(community, 6) AS community, ROUND(hospital, 6) AS hospital, "
                              "ROUND(community + hospital, 6) AS total FROM pv", "Q16 R2 R4 W2 F4 F6"),
    "share_deciles_long": Query(_q_share_deciles_long,
                                f"{V}, per AS (SELECT act.year_month, act.ods_code, prod.vtmnm AS product_name, "
                                "SUM(act.total_quantity) AS q FROM act LEFT JOIN prod ON act.vmp_code = prod.vmp_code "
                                "GROUP BY 1, 2, 3),\nsh AS (SELECT *, q / NULLIF(CASE WHEN COUNT(*) OVER (PARTITION BY "
                                "year_month, ods_code) = COUNT(q) OVER (PARTITION BY year_month, ods_code) THEN SUM(q) "
                                "OVER (PARTITION BY year_month, ods_code) END, 0) AS prop FROM per),\n"
                                f"one AS (SELECT * FROM sh WHERE product_name = '{ONE_MOIETY}'),\n"
                                "dq AS (SELECT year_month, "
                                + ", ".join(f"quantile_cont(prop, {p / 100}) AS Percentile_{p}" for p in range(10, 100, 10))
                                + " FROM one GROUP BY 1)\n"
                                + "\nUNION ALL\n".join(f"SELECT year_month, 'Percentile_{p}' AS decile, "
                                                        f"ROUND(Percentile_{p}, 8) AS prop_prescribing FROM dq"
                                                        for p in range(10, 100, 10)), "Q15 A17 R3 W1 W2 F6"),
    "profile_activity": Query(_q_profile_activity,
                              f"{V}\nSELECT MIN(year_month) AS first_month, MAX(year_month) AS last_month, "
                              "COUNT(DISTINCT ods_code) + MAX(CASE WHEN ods_code IS NULL THEN 1 ELSE 0 END) AS "
                              "n_ods_codes, COUNT(DISTINCT vmp_code) + MAX(CASE WHEN vmp_code IS NULL THEN 1 ELSE 0 "
                              "END) AS n_products, SUM(CASE WHEN total_quantity > 0 THEN total_quantity END) AS "
                              "sum_positive, SUM(CASE WHEN total_quantity < 0 THEN total_quantity END) AS sum_negative "
                              "FROM act", "Q18 A13 A14 A15 N13"),
    "orgs_per_month": Query(_q_orgs_per_month,
                            f"{V}\nSELECT year_month, COUNT(DISTINCT ods_code) AS n FROM act GROUP BY 1", "A9 A12"),
    "negative_profile": Query(_q_negative_profile,
                              f"{V}\nSELECT vmp_code, COUNT(*) AS n, CAST(SUM(CASE WHEN total_quantity < 0 THEN 1 "
                              "ELSE 0 END) AS BIGINT) AS n_negative, ROUND(SUM(CASE WHEN total_quantity < 0 THEN 1 "
                              "ELSE 0 END) / COUNT(*), 6) AS share_negative FROM act GROUP BY 1", "A19 F8"),
    "product_totals_flagged": Query(_q_product_totals_flagged,
                                    f"{V}, t AS (SELECT vmp_code, COALESCE(SUM(total_quantity), 0) AS total_count "
                                    "FROM act GROUP BY 1),\nf AS (SELECT vmp_code, CASE WHEN ddd IS NOT NULL THEN "
                                    "'TRUE' ELSE 'FALSE' END AS ddd_avail FROM prod WHERE dnm IS NOT NULL)\n"
                                    "SELECT t.vmp_code, t.total_count, COALESCE(f.ddd_avail, '(Missing)') AS ddd_avail,"
                                    " CASE WHEN t.total_count >= 0 THEN 'Positive' ELSE 'Negative' END AS "
                                    "positive_count, prod.vmp_name FROM t LEFT JOIN f ON t.vmp_code = f.vmp_code "
                                    "LEFT JOIN prod ON t.vmp_code = prod.vmp_code", "Q19 X17 J7 X15 A16"),
    "column_summary": Query(_q_column_summary,
                            f"{V}\n" + "\nUNION ALL\n".join(
                                f"SELECT '{c}' AS column_name, COUNT({c}) AS n, CAST(SUM(CASE WHEN {c} IS NULL THEN 1 "
                                f"ELSE 0 END) AS BIGINT) AS n_missing, MIN({c}) AS min, MAX({c}) AS max, "
                                f"ROUND(AVG({c}), 6) AS mean FROM vol" for c in ("total_quantity", "volume_ddd")),
                            "A21"),
    "minmax_scaled": Query(_q_minmax_scaled,
                           f"{V}, pt AS (SELECT vmp_code, SUM(total_quantity) AS total_quantity FROM act GROUP BY 1)\n"
                           "SELECT vmp_code, total_quantity, ROUND((total_quantity - (SELECT MIN(total_quantity) FROM "
                           "pt)) / NULLIF((SELECT MAX(total_quantity) FROM pt) - (SELECT MIN(total_quantity) FROM pt)"
                           ", 0), 8) AS scaled FROM pt", "W8"),
    "label_columns": Query(_q_label_columns,
                           f"{V}, nat AS (SELECT year_month, vtmnm, {_micro_sql(False)} AS u FROM vol "
                           "GROUP BY 1, 2),\np AS (SELECT year_month, vtmnm, u / 1e6 AS volume_ddd, u / NULLIF("
                           "COALESCE(SUM(u) OVER (PARTITION BY year_month), 0), 0) AS prop FROM nat),\nl AS (SELECT *, strftime(year_month, "
                           "'%b') AS month_label, CAST(year(year_month) AS INTEGER) AS year, format('{:,}', "
                           "CAST(ROUND(volume_ddd) AS BIGINT)) AS volume_label, CAST(ROUND(prop * 1000) AS BIGINT) AS "
                           "pm FROM p),\nl2 AS (SELECT *, CASE WHEN pm < 0 THEN '-' ELSE '' END || CAST(abs(pm) // 10 "
                           "AS VARCHAR) || '.' || CAST(abs(pm) % 10 AS VARCHAR) || '%' AS share_label FROM l)\n"
                           "SELECT year_month, vtmnm, month_label, year, volume_label, share_label, 'Month: ' || "
                           "month_label || ' ' || CAST(year AS VARCHAR) || '; Volume: ' || volume_label || ' (' || "
                           "share_label || '); Medication: ' || vtmnm AS label FROM l2", "X5 X6 X8"),
    "name_cleanup": Query(_q_name_cleanup,
                          f"{V}, raw AS (SELECT p_partkey AS ods_code, upper(p_name || ' and ' || p_type || "
                          "' nhs and trust') AS nm, strftime(DATE '1995-01-01' + CAST(p_size * 37 AS INTEGER), "
                          "'%Y%m%d') AS od FROM part),\nt AS (SELECT ods_code, array_to_string(list_transform("
                          "string_split(lower(nm), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS tc, od FROM raw)\n"
                          "SELECT ods_code, regexp_replace(regexp_replace(tc, 'Nhs', 'NHS'), 'And', 'and') AS "
                          "ods_name, CAST(strptime(od, '%Y%m%d') AS DATE) AS open_date, "
                          "CAST(date_trunc('month', strptime(od, '%Y%m%d')) AS DATE) AS open_month FROM t",
                          "Q20 X1 X2 X3 X4 P3 P7"),
    "category_order": Query(_q_category_order,
                            f"{V}{VOLA_SQL},\nm AS (SELECT COALESCE(stp_name, '(Missing)') AS stp_name, vtmnm, {_micro_sql(False)} AS u "
                            "FROM vola GROUP BY 1, 2),\nt AS (SELECT stp_name, SUM(u) AS total FROM m GROUP BY 1)\n"
                            "SELECT stp_name, total / 1e6 AS total, ROW_NUMBER() OVER (ORDER BY total DESC, stp_name) "
                            "AS sort_order FROM t", "O2 O3 O6"),
    "trust_rank": Query(_q_trust_rank,
                        f"{V}, m AS (SELECT ods_code, vtmnm, {_micro_sql(False)} AS u FROM vol GROUP BY 1, 2),\n"
                        "t AS (SELECT ods_code, SUM(u) AS total FROM m GROUP BY 1)\nSELECT ods_code, total / 1e6 AS total, DENSE_RANK() OVER (ORDER BY total DESC) "
                        "AS rank FROM t",
                        "W4 N7"),
    "head_preview": Query(_q_head_preview,
                          f"{V}\nSELECT * FROM act ORDER BY vmp_code, year_month, ods_code LIMIT 100", "O5"),
    "csv_round_trip": Query(_q_csv_round_trip,
                            f"{V}\nSELECT CAST(vmp_code AS VARCHAR) AS vmp_code, vmp_name, bnf_code, nmr, dnm, ddd "
                            "FROM prod", "S3 S7 N12"),
    "xml_round_trip": Query(_q_xml_round_trip,
                            f"{V}\nSELECT CAST(vmp_code AS VARCHAR) AS VPID, bnf_code AS BNF, vtmnm AS ATC, "
                            "CAST(CAST(ddd AS DECIMAL(18, 4)) AS DOUBLE) AS DDD, CASE WHEN dnm IS NOT NULL THEN 'mg' "
                            "END AS DDD_UOMCD FROM prod", "S6 X16 S7"),
    "materialised_lookup": Query(_q_materialised_lookup, f"{V}\n{_ingredient_sql(EXACT_NAMES, False)}",
                                 "S8 S9"),
    "register_tidy": Query(_q_register_tidy,
                           f"{V}, raw AS (SELECT 'T' || s_suppkey AS ods_code, upper(s_name || ' and vale nhs and care "
                           "trust') AS nm, 'Y' || (s_suppkey % 7) AS region_code, CASE WHEN s_suppkey = 1 THEN 'QX1' "
                           "WHEN s_suppkey = 7 THEN 'QX7' WHEN s_suppkey % 10 <> 0 THEN 'Q' || s_nationkey END AS "
                           "stp_code, CAST(DATE '1995-01-01' + CAST(s_suppkey % 3000 AS INTEGER) AS DATE) AS open_date,"
                           " CASE WHEN s_suppkey % 4 = 0 THEN DATE '2020-03-31' END AS close_date FROM supplier),\n"
                           "t AS (SELECT *, array_to_string(list_transform(string_split(lower(nm), ' '), "
                           "lambda w: upper(w[1]) || w[2:]), ' ') AS tc FROM raw)\n"
                           "SELECT ods_code, regexp_replace(regexp_replace(tc, 'Nhs', 'NHS'), 'And', 'and') AS "
                           "ods_name, region_code, stp_code, open_date, close_date, 0 AS amended_record_indicator "
                           "FROM t", "S4 Q20 X1 X2 X3 X12 P3 P7"),
    "csv_base_blanks": Query(_q_csv_base_blanks,
                             f"{V}\nSELECT vmp_code, CASE WHEN vmp_code % 3 = 0 THEN '' WHEN vmp_code % 3 = 2 THEN "
                             "vmp_name END AS vmp_name, CASE WHEN vmp_code % 5 > 1 THEN ddd END AS ddd FROM prod",
                             "S5 N12"),
    "sql_over_views": Query(_q_sql_over_views,
                            f"{V}\nSELECT act.year_month, orgs.stp_code, SUM(act.total_quantity) AS total_quantity "
                            "FROM act LEFT JOIN orgs ON act.ods_code = orgs.ods_code GROUP BY 1, 2", "S1 S2"),
    "product_totals_filtered": Query(_q_product_totals_filtered,
                                     f"{V}, t AS (SELECT vmp_code, COALESCE(SUM(total_quantity), 0) AS total_count FROM "
                                     "act GROUP BY 1),\nf AS (SELECT vmp_code, CASE WHEN ddd IS NOT NULL THEN 'TRUE' "
                                     "ELSE 'FALSE' END AS ddd_avail FROM prod WHERE dnm IS NOT NULL)\nSELECT * FROM ("
                                     "SELECT t.vmp_code, t.total_count, COALESCE(f.ddd_avail, '(Missing)') AS ddd_avail,"
                                     " 'Positive' AS positive_count FROM t LEFT JOIN f ON t.vmp_code = f.vmp_code "
                                     "WHERE t.total_count >= 0) WHERE ddd_avail <> 'TRUE'", "F10 Q19"),
    "common_areas": Query(_q_common_areas,
                          f"{V}\nSELECT stp_code FROM orgs INTERSECT SELECT stp_code FROM ccg_map", "U4"),
    "share_labels": Query(_q_share_labels,
                          f"{V}{TOP20_AREAS_SQL_CTE}\n" + "\nUNION ALL\n".join(
                              f"SELECT '{m}' AS medication, stp_name, COALESCE(MAX(CASE WHEN vtmnm = '{m}' THEN "
                              "COALESCE(round_even(prop_use, 3), 0) END), 0) AS prop_use FROM top "
                              "GROUP BY stp_name, total" for m in MOIETIES), "X9 P4 P5 P6"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.build for name, q in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in CATALOG.items() if q.sql is not None}

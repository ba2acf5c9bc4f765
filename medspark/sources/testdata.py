"""The driver's TPC-H-like tables mapped onto the medicines domain.

The test tables carry no medicines; these views give them the domain's
shape.  Each view exists twice - a DataFrame builder for the library and a
SQL text for the independent DuckDB oracle - written side by side so the two
stay the same.  Missing values are derived by fixed rules on the keys (the
tables themselves hold no NULL); the rules fill columns, they never drop rows.

| view        | domain meaning                              | from                              |
|-------------|---------------------------------------------|-----------------------------------|
| activity    | hospital issues per month, trust, product   | lineitem (returns negative)       |
| products    | product dictionary (moiety, strength, DDD)  | part                              |
| orgs        | trust register (area code may be missing)   | supplier                          |
| areas       | area -> name, region                        | nation, region                    |
| ccg_map     | community commissioner -> area, region      | customer, nation, region          |
| community   | community issues per month, CCG, product    | lineitem, orders, part            |
| links/ings  | product -> ingredient words                 | part names                        |
| volume      | activity converted to daily doses           | activity + products               |
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medspark.functions.dose import (dose_factor, dose_units, quantity_units, strength_per_single, volume_ddd,
                                     volume_singles)
from medspark.functions.scalars import in_months, month_start
from medspark.operators import activity as activity_ops

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


# Declared schemas of the tables the views read: no schema-inference job per
# read, and a file with a different layout fails instead of changing types.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": ("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
             "p_retailprice double"),
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                 "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                 "l_linestatus string, l_shipdate timestamp_ntz"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read with its declared schema."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- activity ----------------------------------------------------------------

def issues(spark: SparkSession, sf_dir: str, codes: DataFrame | None = None,
           without: DataFrame | None = None, period: tuple[str, str] | None = None) -> DataFrame:
    """Issued quantities row by row, returns negative: month, organisation, product.
    ``codes`` / ``without`` (vmp_code) and ``period`` (closed range of months)
    filter the raw rows."""
    rows = activity_ops.issues(table(spark, sf_dir, "lineitem"), "l_shipdate", "l_partkey", period=period,
                               codes=codes, without=without, codelist_col="vmp_code")
    return rows.select(month_start("l_shipdate").alias("year_month"), F.col("l_suppkey").alias("ods_code"),
                       F.col("l_partkey").alias("vmp_code"), _signed().alias("quantity"))


def _signed() -> Column:
    return F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))


def activity(spark: SparkSession, sf_dir: str, codes: DataFrame | None = None,
             without: DataFrame | None = None, period: tuple[str, str] | None = None) -> DataFrame:
    """A1: SUM of signed quantities GROUP BY month, organisation, product; filters as
    for ``issues``."""
    return activity_ops.monthly_activity(issues(spark, sf_dir, codes, without, period), "year_month", "ods_code",
                                         "vmp_code", "quantity", code_out="vmp_code")


ACTIVITY_SQL = """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS year_month, l_suppkey AS ods_code,
       l_partkey AS vmp_code,
       SUM(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS total_quantity
FROM lineitem GROUP BY 1, 2, 3"""


# --- products ------------------------------------------------------------------

def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary: moiety = type, udfs = size, strength numerator = price;
    denominator missing for keys divisible by 3; DDD missing for the whole moiety PROMO
    and for a few products (keys divisible by 50) of SMALL, so that strict sums are
    missing for some groups and have a value for others."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("vmp_code"), F.col("p_name").alias("vmp_name"), F.col("p_brand").alias("bnf_code"),
        F.col("p_type").alias("vtmnm"), F.col("p_size").cast("double").alias("udfs"),
        F.col("p_retailprice").alias("nmr"),
        F.when(k % 3 != 0, (k % 7 + 1).cast("double")).alias("dnm"),
        F.when((F.col("p_type") == "PROMO") | (F.col("p_type") == "SMALL") & (k % 50 == 0), F.lit(None))
        .otherwise((k % 11 + 1).cast("double")).alias("ddd"))


PRODUCTS_SQL = """SELECT p_partkey AS vmp_code, p_name AS vmp_name, p_brand AS bnf_code, p_type AS vtmnm,
       CAST(p_size AS DOUBLE) AS udfs, p_retailprice AS nmr,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_partkey % 7 + 1 AS DOUBLE) END AS dnm,
       CASE WHEN p_type = 'PROMO' OR p_type = 'SMALL' AND p_partkey % 50 = 0 THEN NULL
            ELSE CAST(p_partkey % 11 + 1 AS DOUBLE) END AS ddd
FROM part"""


def ingredient_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product -> ingredient link: every word of the product name (fans out, like vpi)."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("vmp"),
                    F.explode(F.split(F.col("p_name"), " ")).alias("ing")).distinct()


LINKS_SQL = """SELECT DISTINCT p_partkey AS vmp, unnest(string_split(p_name, ' ')) AS ing FROM part"""


def ingredients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingredient table: one row per distinct word (id and name are the word)."""
    return ingredient_links(spark, sf_dir).select(F.col("ing").alias("id"), F.col("ing").alias("nm")).distinct()


INGREDIENTS_SQL = """SELECT DISTINCT ing AS id, ing AS nm FROM links"""


# --- organisations and areas ---------------------------------------------------

def orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trust register; the area code is missing for keys divisible by 10."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.alias("ods_code"), F.col("s_name").alias("ods_name"),
                    F.when(k % 10 != 0, F.col("s_nationkey")).alias("stp_code"))


ORGS_SQL = """SELECT s_suppkey AS ods_code, s_name AS ods_name,
       CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE s_nationkey END AS stp_code
FROM supplier"""


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area map: area code -> area name and region name."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        F.col("n_nationkey").alias("stp_code"), F.col("n_name").alias("stp_name"),
        F.col("r_name").alias("comm_region_name"))


AREAS_SQL = """SELECT n_nationkey AS stp_code, n_name AS stp_name, r_name AS comm_region_name
FROM nation JOIN region ON n_regionkey = r_regionkey"""


def ccg_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commissioner (customer) -> area code, area name, region name."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("ccg_code"), F.col("c_nationkey").alias("stp_code")).join(
        areas(spark, sf_dir), "stp_code", "left")


CCG_MAP_SQL = """SELECT c_custkey AS ccg_code, c_nationkey AS stp_code, stp_name, comm_region_name
FROM customer LEFT JOIN areas ON c_nationkey = areas.stp_code"""


def community_issues(spark: SparkSession, sf_dir: str, period: tuple[str, str] | None = None) -> DataFrame:
    """Second source row by row: month of the order, commissioner, moiety, quantity."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if period is not None:
        o = o.where(in_months("o_orderdate", *period))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"])
    return j.select(month_start("o_orderdate").alias("month"), F.col("o_custkey").alias("ccg_code"),
                    F.col("p_type").alias("product_name"), F.col("l_quantity").alias("quantity"))


def community(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second source: quantities per order month, commissioner and moiety."""
    return (community_issues(spark, sf_dir).groupBy("month", "ccg_code", "product_name")
            .agg(F.sum("quantity").alias("quantity")))


COMMUNITY_SQL = """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_custkey AS ccg_code,
       p_type AS product_name, SUM(l_quantity) AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
GROUP BY 1, 2, 3"""


# --- dose volume ---------------------------------------------------------------

def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per product: moiety and daily doses for one unit (X11)."""
    return products(spark, sf_dir).select("vmp_code", "vtmnm", dose_factor("udfs", "nmr", "dnm", "ddd").alias("factor"))


def volume(spark: SparkSession, sf_dir: str, period: tuple[str, str] | None = None) -> DataFrame:
    """Activity joined to the dictionary and converted to daily doses (X11), as a
    double and in exact units."""
    prod = products(spark, sf_dir).select("vmp_code", "vtmnm", "udfs", "nmr", "dnm", "ddd")
    j = activity(spark, sf_dir, period=period).join(prod, "vmp_code", "left")
    units = dose_units(quantity_units("total_quantity"), dose_factor("udfs", "nmr", "dnm", "ddd"))
    return j.select("year_month", "ods_code", "vmp_code", "total_quantity", "vtmnm",
                    volume_ddd("total_quantity", "udfs", "nmr", "dnm", "ddd").alias("volume_ddd"),
                    units.alias("volume_units"))


_STRENGTH_SQL = "CASE WHEN prod.dnm IS NULL THEN prod.nmr ELSE prod.nmr * (prod.udfs / prod.dnm) END"
VOLUME_SQL = f"""SELECT act.year_month, act.ods_code, act.vmp_code, act.total_quantity, prod.vtmnm,
       (act.total_quantity / prod.udfs) * {_STRENGTH_SQL} / NULLIF(prod.ddd, 0) AS volume_ddd,
       CAST(FLOOR(act.total_quantity * 1000 + 0.5) AS HUGEINT)
         * CAST(FLOOR((1.0 / prod.udfs) * {_STRENGTH_SQL} / NULLIF(prod.ddd, 0) * 1e9 + 0.5) AS HUGEINT) AS volume_units
FROM act LEFT JOIN prod ON act.vmp_code = prod.vmp_code"""


def dose_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-level conversion with the intermediate volumes (Q5)."""
    act = activity(spark, sf_dir)
    prod = products(spark, sf_dir).select("vmp_code", "vtmnm", "udfs", "nmr", "dnm", "ddd")
    j = act.join(prod, "vmp_code", "left")
    singles = volume_singles("total_quantity", "udfs")
    mg = singles * strength_per_single("udfs", "nmr", "dnm")
    return j.select("year_month", "ods_code", "vmp_code", "vtmnm", "total_quantity",
                    singles.alias("volume_singles"), mg.alias("volume_mg_strength"),
                    F.try_divide(mg, F.col("ddd")).alias("volume_ddd"))


# CTE prefix shared by every oracle query (DuckDB drops the unused ones).
VIEWS_SQL = ("WITH act AS (" + ACTIVITY_SQL + "),\nprod AS (" + PRODUCTS_SQL + "),\norgs AS (" + ORGS_SQL
             + "),\nareas AS (" + AREAS_SQL + "),\nccg_map AS (" + CCG_MAP_SQL + "),\ncommunity AS ("
             + COMMUNITY_SQL + "),\nlinks AS (" + LINKS_SQL + "),\nings AS (" + INGREDIENTS_SQL
             + "),\nvol AS (" + VOLUME_SQL + ")\n")


VIEW_BUILDERS = {"act": activity, "prod": products, "orgs": orgs, "areas": areas, "ccg_map": ccg_map,
                 "community": community, "links": ingredient_links, "ings": ingredients, "vol": volume}


def register_views(spark: SparkSession, sf_dir: str, prefix: str = "") -> list[str]:
    """Register the domain views as temporary views, so SQL text
    (``spark.sql("SELECT ... FROM vol ...")``) runs on them lazily, as the
    warehouse SQL strings did.  Returns the registered names."""
    names = []
    for name, build in VIEW_BUILDERS.items():
        build(spark, sf_dir).createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names

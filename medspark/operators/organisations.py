"""Organisation registers (SURVEY: U3, U4, U6, A8, X12, X14, Q1, Q2).

Overrides are data: a two-column table ``(code, replacement)`` joined to the
register.  Literal override lists are broadcast (fixed size); the result is
``coalesce(replacement, original)``, which equals a ``case_when`` over the
codes with ``TRUE ~ original`` as its last branch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medspark.functions.scalars import parse_digits_date, replace_first, snake_case_names, title_case
from medspark.functions.semantics import explicit_missing
from medspark.operators.joins import anti_join
from medspark.sources.literals import literal_table

# --- fixed values -----------------------------------------------------------
# Organisation code -> area (STP) code corrections for codes that the activity
# data still uses but the register files differently.  The wider rule set
# (10 rules) is the default; the first six are the older set.
AREA_OVERRIDES: dict[str, str] = {
    "RQ6": "QYG",
    "RNL": "QHM",
    "RE9": "QHM",
    "RLN": "QHM",
    "RM2": "QOP",
    "RW3": "QOP",
    "RGQ": "QJG",
    "RJF": "QJ2",
    "RR1": "QHL",
    "R1J": "QR1",
    "R1E": "QNC",
    "TAD": "QWO",
    "TAJ": "QUA",
}
AREA_OVERRIDES_OLDER: dict[str, str] = {
    "RQ6": "QYG",
    "RNL": "QHM",
    "RE9": "QHM",
    "RLN": "QHM",
    "RM2": "QOP",
    "RW3": "QOP",
    "RGQ": "QJG",
    "RJF": "QJ2",
    "RR1": "QHL",
}
# Column names of the headerless organisation register file, in file order
# (positions 13-17, 19-21, 23 and 25-27 are not used and are dropped).
REGISTER_COLUMNS: list[str] = [
    "Organisation Code", "Name", "National Grouping", "High Level Health Geography",
    "Address Line 1", "Address Line 2", "Address Line 3", "Address Line 4", "Address Line 5",
    "Postcode", "Open Date", "Close Date", "DROP_1", "DROP_2", "DROP_3", "DROP_4", "DROP_5",
    "Contact Telephone Number", "DROP_6", "DROP_7", "DROP_8", "Amended Record Indicator",
    "DROP_9", "GOR Code", "DROP_10", "DROP_11", "DROP_12",
]
# Organisation code -> display name for two merged organisations.
NAME_OVERRIDES: dict[str, str] = {
    "RM2": "UNIVERSITY HOSPITAL OF SOUTH MANCHESTER NHS FOUNDATION TRUST",
    "RR1": "HEART OF ENGLAND NHS FOUNDATION TRUST",
}
# ---------------------------------------------------------------------------


def override_table(spark: SparkSession, overrides: Mapping, key_type: str = "string",
                   value_type: str = "string") -> DataFrame:
    """A broadcast ``(_key, _value)`` table from a literal mapping."""
    return F.broadcast(literal_table(spark, list(overrides.items()), f"_key {key_type}, _value {value_type}"))


def apply_override(df: DataFrame, key: str, target: str, overrides: Mapping | DataFrame,
                   key_type: str | None = None, value_type: str | None = None) -> DataFrame:
    """Replace ``target`` where ``key`` has an override (else keep it)."""
    if isinstance(overrides, DataFrame):
        table = overrides.toDF("_key", "_value")
    else:
        types = dict(df.dtypes)
        table = override_table(df.sparkSession, overrides, key_type or types[key],
                               value_type or types[target])
    joined = df.join(table, df[key] == table["_key"], "left")
    return joined.select(*[F.coalesce(F.col("_value"), F.col(c)).alias(c) if c == target else F.col(c)
                           for c in df.columns])


def current_plus_historic(current: DataFrame, historic: DataFrame, key: str = "ods_code") -> DataFrame:
    """U6 (U4 + F7 + U3): the current register plus organisations found only
    in the historic one; for a shared code the current row wins."""
    only_old = anti_join(historic, current.select(key), key, null_safe=True)
    return current.unionByName(only_old)


def first_per_group(df: DataFrame, by: str | Sequence[str], order: str, cols: Sequence[str],
                    count_col: str | None = "n") -> DataFrame:
    """A8 (+A9): per group, the values of the row with the smallest ``order``
    (deterministic ``first``, N8) and optionally the row count."""
    by = [by] if isinstance(by, str) else list(by)
    aggs = [F.min_by(F.col(c), F.col(order)).alias(c) if c != order else F.min(order).alias(c)
            for c in cols]
    if count_col:
        aggs = [F.count(F.lit(1)).alias(count_col)] + aggs
    return df.groupBy(*by).agg(*aggs)


def area_listing(register: DataFrame, area_map: DataFrame, key: str = "stp_code",
                 name_col: str = "ods_name", area_name: str = "stp_name",
                 region_name: str = "comm_region_name") -> DataFrame:
    """Q1: organisation name with its area and region, missing made explicit."""
    return (register.join(area_map, key, "left")
            .select(name_col, explicit_missing(area_name).alias(area_name),
                    explicit_missing(region_name).alias(region_name)))


def area_coverage(register: DataFrame, area_map: DataFrame, key: str = "stp_code",
                  code_col: str = "ods_code", name_col: str = "ods_name") -> DataFrame:
    """Q2: per area code, number of organisations and the first one (by code),
    joined to the area names; NA codes form their own group."""
    counts = first_per_group(register, key, code_col, [code_col, name_col])
    return counts.join(area_map, counts[key].eqNullSafe(area_map[key]), "left").drop(area_map[key])


def register_names() -> list[str]:
    """The register's column names in snake case."""
    return snake_case_names(REGISTER_COLUMNS)


def tidy_register(raw: DataFrame, area_overrides: Mapping | None = None) -> DataFrame:
    """Q20: clean the raw organisation register.

    Drops the unused columns, title-cases the name and then fixes only the
    FIRST "Nhs" and the FIRST "And" (X1 X2), parses the ``yyyymmdd`` dates
    (X3), renames the key columns (P3) and applies the area overrides (X12;
    default: the older six rules).  ``raw`` has the snake-case column names
    of ``register_names()``, all text.
    """
    overrides = AREA_OVERRIDES_OLDER if area_overrides is None else area_overrides
    keep = [c for c in raw.columns if not c.startswith("drop") and c != "contact_telephone_number"]
    name = replace_first(replace_first(title_case("name"), "Nhs", "NHS"), "And", "and")
    df = raw.select(*keep).withColumns({
        "name": name,
        "open_date": parse_digits_date("open_date"),
        "close_date": parse_digits_date("close_date"),
        "amended_record_indicator": F.col("amended_record_indicator").cast("int"),
    }).withColumnsRenamed({"national_grouping": "region_code", "high_level_health_geography": "stp_code",
                           "organisation_code": "ods_code", "name": "ods_name"})
    return apply_override(df, "ods_code", "stp_code", overrides) if overrides else df

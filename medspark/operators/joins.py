"""Join operators and the broadcast policy.

Broadcast policy
----------------
* Literal lookups built on the driver (override maps, dose tables, codelists
  typed in by the user) have a size fixed by construction: they are hinted
  with ``broadcast``.
* Lookups derived from tables (registers, dictionaries, area maps) are NOT
  hinted: their size grows with the data.  Spark broadcasts them only when
  the planner's size estimate is under ``spark.sql.autoBroadcastJoinThreshold``
  and AQE re-plans at run time from the real shuffle sizes; above the limit
  the join stays a shuffle join, and AQE splits a skewed key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from medspark.functions.semantics import null_safe_condition
from medspark.sources.literals import literal_table


def literal_lookup(spark: SparkSession, rows: Sequence[tuple], schema: StructType | str) -> DataFrame:
    """An inline lookup table, broadcast (its size is fixed on the driver)."""
    return F.broadcast(literal_table(spark, rows, schema))


def _key_pairs(on: str | Sequence[str] | dict[str, str]) -> list[tuple[str, str]]:
    if isinstance(on, str):
        return [(on, on)]
    if isinstance(on, dict):
        return list(on.items())
    return [(k, k) for k in on]


def join_left(left: DataFrame, right: DataFrame, on: str | Sequence[str] | dict[str, str],
              null_safe: bool = False, how: str = "left") -> DataFrame:
    """Dplyr-style join by key names.

    ``on`` is a name, a list of shared names, or ``{left_name: right_name}``
    for differently named keys (J6).  Output keeps the left key columns once
    and drops the right keys, like ``left_join(x, y, by=...)``.
    ``null_safe=True`` matches NA to NA (N5); SQL-style joins leave it False.
    """
    pairs = _key_pairs(on)
    if not null_safe and all(lk == rk for lk, rk in pairs):
        return left.join(right, [lk for lk, _ in pairs], how)
    lalias, ralias = left.alias("_l"), right.alias("_r")
    cond = null_safe_condition([F.col(f"_l.{lk}") for lk, _ in pairs],
                               [F.col(f"_r.{rk}") for _, rk in pairs], null_safe)
    right_keys = {rk for _, rk in pairs}
    joined = lalias.join(ralias, cond, how)
    out_cols = [F.col(f"_l.{c}") for c in left.columns]
    if how not in ("left_semi", "semi", "left_anti", "anti"):
        out_cols += [F.col(f"_r.{c}") for c in right.columns
                     if c not in right_keys and c not in left.columns]
    return joined.select(*out_cols)


def natural_left_join(left: DataFrame, right: DataFrame, null_safe: bool = True) -> DataFrame:
    """Left join on every column name the two sides share (dplyr default)."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("natural join: no shared column names")
    return join_left(left, right, shared, null_safe=null_safe)


def semi_join(df: DataFrame, keys: DataFrame, on: str | Sequence[str] | dict[str, str],
              null_safe: bool = False) -> DataFrame:
    """Rows of ``df`` whose key appears in ``keys``."""
    return join_left(df, keys, on, null_safe=null_safe, how="left_semi")


def anti_join(df: DataFrame, keys: DataFrame, on: str | Sequence[str] | dict[str, str],
              null_safe: bool = True) -> DataFrame:
    """Rows of ``df`` whose key is absent from ``keys``.

    N11: R's ``!x %in% y`` treats NA as a value, so by default NA matches NA
    here and a NULL key is kept unless ``keys`` also holds a NULL.
    """
    return join_left(df, keys, on, null_safe=null_safe, how="left_anti")


def duplicate_keys(df: DataFrame, keys: Sequence[str], count_col: str = "n") -> DataFrame:
    """Key values that occur more than once (with their multiplicity)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col))
            .where(F.col(count_col) > 1))


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """J11 as a guard: raise if ``keys`` do not identify rows (one small action)."""
    dup = duplicate_keys(df, keys).limit(5).collect()
    if dup:
        raise ValueError(f"keys {list(keys)} are not unique, e.g. {dup}")

"""Projection operators.  All are schema-level: no job runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from medspark.functions.scalars import snake_case_names


def select_as(df: DataFrame, mapping: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """``SELECT a AS b, ...`` from ``{source: alias}`` (or plain names)."""
    if isinstance(mapping, Mapping):
        return df.select(*[F.col(src).alias(dst) for src, dst in mapping.items()])
    return df.select(*mapping)


def cast_to_string(df: DataFrame, *cols: str) -> DataFrame:
    """Codes kept as text (ids of 15-18 digits must never pass through double)."""
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """``rename(new = old)`` given as ``{old: new}``."""
    return df.withColumnsRenamed(dict(mapping))


def drop_columns(df: DataFrame, *cols: str) -> DataFrame:
    """``select(-c(...))``."""
    return df.drop(*cols)


def select_prefix(df: DataFrame, prefix: str, keep: Sequence[str] = (), exclude: bool = False) -> DataFrame:
    """P5: keep ``keep`` plus columns starting with ``prefix`` (or all but them)."""
    if exclude:
        return df.select(*[c for c in df.columns if not c.startswith(prefix)])
    chosen = [c for c in df.columns if c.startswith(prefix) and c not in keep]
    return df.select(*keep, *chosen)


def relocate(df: DataFrame, *first: str) -> DataFrame:
    """Move ``first`` to the front, keep the rest in order."""
    return df.select(*first, *[c for c in df.columns if c not in first])


def clean_names(df: DataFrame) -> DataFrame:
    """Snake-case every column name (``janitor::clean_names``)."""
    return df.toDF(*snake_case_names(df.columns))


def with_constant(df: DataFrame, name: str, value, dtype: DataType | str | None = None) -> DataFrame:
    """Add a constant or a typed NULL column."""
    col = F.lit(value)
    if dtype is not None:
        col = col.cast(dtype)
    return df.withColumn(name, col)


def require_columns(df: DataFrame, *cols: str) -> DataFrame:
    """Fail early when an input lacks a required column."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}; have {df.columns}")
    return df


def r_order(*cols: str, descending: bool | Sequence[bool] = False) -> list:
    """O2/O3: sort keys with missing values last in both directions (R's
    ``arrange``), unlike Spark's ascending default that puts NULLs first."""
    flags = [descending] * len(cols) if isinstance(descending, bool) else list(descending)
    return [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in zip(cols, flags, strict=True)]

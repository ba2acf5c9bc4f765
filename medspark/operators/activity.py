"""Monthly activity (A1): the first step of every hospital report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medspark.functions.scalars import in_months, month_start
from medspark.operators.codelists import in_codelist, not_in_codelist


def issues(df: DataFrame, date: str, code: str, *, period: tuple[str, str] | None = None,
           codes: DataFrame | Sequence | None = None, without: DataFrame | None = None,
           codelist_col: str | None = None) -> DataFrame:
    """Raw rows of some months (F4, closed range) and products (F1, F7).  The
    filters stand on the raw columns, so the scan gets them."""
    if period is not None:
        df = df.where(in_months(date, *period))
    if codes is not None:
        df = in_codelist(df, code, codes, codelist_col)
    if without is not None:
        df = not_in_codelist(df, code, without, codelist_col)
    return df


def monthly_activity(df: DataFrame, date: str, org: str, code: str, value: Column | str, name: str | None = None, *,
                     month_out: str = "year_month", org_out: str = "ods_code", code_out: str = "vmp_snomed_code",
                     name_out: str = "vmp_product_name", value_out: str = "total_quantity") -> DataFrame:
    """A1: SUM of ``value`` by month of ``date``, organisation, product code and, if
    given, product name.  ``date`` may be a date, a timestamp or already a month.

    Missing keys are groups of their own; missing values are skipped, and a group of
    missing values alone has a missing total (N4, as SQL sums)."""
    keys = [month_start(date).alias(month_out), F.col(org).alias(org_out), F.col(code).alias(code_out)]
    if name is not None:
        keys.append(F.col(name).alias(name_out))
    return df.groupBy(*keys).agg(F.sum(value).alias(value_out))

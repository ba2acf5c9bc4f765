"""Reshaping and the share table.

A pivot's categories are given, or found in the data (one distinct over what is
by then an aggregated table; a missing category is the column ``NA``).  A category
that is not in a given list is an error, never a dropped row.  A pivot is a grouped
aggregate, so its shuffle is keyed by the id columns only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medspark.functions.semantics import round_half_even
from medspark.operators.columns import require_columns


MAX_CATEGORIES = 2000  # columns of a measure that a pivot makes from the data


def categories_of(df: DataFrame, col: str) -> list[str | None]:
    """The distinct categories in name order, a missing one last; more than
    ``MAX_CATEGORIES`` are an error, since each becomes columns."""
    found = df.select(col).distinct().limit(MAX_CATEGORIES + 1).collect()
    if len(found) > MAX_CATEGORIES:
        raise ValueError(f"column {col} has more than {MAX_CATEGORIES} categories; name the wanted ones")
    return sorted((r[0] for r in found), key=lambda x: (x is None, x))


def _shown(category: str | None) -> str:
    return "NA" if category is None else str(category)


def _listed(df: DataFrame, col: str, values: Sequence[str | None]) -> Column:
    """The category column; a row with an unlisted category raises."""
    known = F.lit(False)
    for v in values:
        known = known | F.col(col).eqNullSafe(F.lit(v))
    told = F.concat(F.lit(f"unlisted category in {col}: "), F.coalesce(F.col(col).cast("string"), F.lit("NA")))
    return F.when(known, F.col(col)).otherwise(F.raise_error(told).cast(df.schema[col].dataType))


def pivot_wider(df: DataFrame, id_cols: Sequence[str], names_from: str, values_from: Sequence[str],
                values: Sequence[str | None] | None = None, values_fill: float | None = None) -> DataFrame:
    """``pivot_wider``; output columns are ``<measure>_<category>``, of all
    categories in name order (missing last) when ``values`` is not given.

    Cells absent from the input get ``values_fill`` (None keeps NULL); cells
    present with a NULL measure stay NULL, as in tidyr.
    """
    if values is None:
        values = categories_of(df, names_from)
    category, aggs = _listed(df, names_from, values), []
    for v in values:
        for m in values_from:
            cell = F.first(F.when(category.eqNullSafe(F.lit(v)), F.col(m)), ignorenulls=True)
            present = F.max(F.when(category.eqNullSafe(F.lit(v)), F.lit(1)))
            if values_fill is not None:
                cell = F.when(present.isNull(), F.lit(values_fill)).otherwise(cell)
            aggs.append((m, v, cell))
    names = {(m, v): f"{m}_{_shown(v)}" if len(values_from) > 1 else _shown(v) for m, v, _ in aggs}
    grouped = df.groupBy(*id_cols).agg(*[c.alias(names[(m, v)]) for m, v, c in aggs])
    ordered = [names[(m, v)] for m in values_from for v in values]
    return grouped.select(*id_cols, *ordered)


def pivot_one(df: DataFrame, id_cols: Sequence[str], names_from: str, value: str,
              values: Sequence[str]) -> DataFrame:
    """R2: one measure cast wide; column names are the category values, absent cells NULL."""
    category = _listed(df, names_from, values)
    aggs = [F.first(F.when(category.eqNullSafe(F.lit(v)), F.col(value)), ignorenulls=True).alias(_shown(v))
            for v in values]
    return df.groupBy(*id_cols).agg(*aggs)


def unpivot_longer(df: DataFrame, ids: Sequence[str], values: Sequence[str],
                   names_to: str = "variable", values_to: str = "value") -> DataFrame:
    """``melt(id = ...)`` - wide to long, one row per id and measure."""
    return df.unpivot(list(ids), list(values), names_to, values_to)


def fill_missing(df: DataFrame, fills: Mapping[str, float]) -> DataFrame:
    """``replace_na(list(col = value))``."""
    return df.fillna(dict(fills))


def share_table(df: DataFrame, id_col: str, category: str, categories: Sequence[str | None] | None = None,
                share: str = "prop_use", volume: str = "volume_ddd", total: str = "total",
                digits: int = 3) -> DataFrame:
    """Round shares (half-even), zero-fill, pivot volume and share by category,
    keep ``id``, the ``<share>_<category>`` columns and the total (R1 R5 P5 X7)."""
    require_columns(df, id_col, category, volume, share, total)  # P9
    prepared = fill_missing(df.withColumn(share, round_half_even(share, digits)),
                            {volume: 0.0, share: 0.0})
    if categories is None:
        categories = categories_of(prepared, category)
    wide = pivot_wider(prepared, [id_col, total], category, [volume, share], categories,
                       values_fill=0.0)
    share_cols = [f"{share}_{_shown(c)}" for c in categories]
    return wide.select(id_col, *share_cols, total)

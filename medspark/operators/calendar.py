"""Calendar operators.

Gap filling follows ``as_tsibble(key, index) |> fill_gaps(v = 0, .full = TRUE)``:
every observed key gets every month from the global first month to the global
last month, new months get the fill value.

Plan shape
1. The input is reduced to one row per (key, month) - a partial + final hash
   aggregate, so even a key holding a third of all rows is pre-aggregated
   before its shuffle.
2. One ``groupBy(key)`` gathers each key's observed months - at most the
   calendar length, whatever the raw row count - as a month-sorted list.
3. The dense array is assembled from that sparse list: per observed month,
   the zeros of the gap before it plus its value (``zip_with`` + ``flatten``),
   then trailing zeros.  Work per key is proportional to its OBSERVED months,
   not to the calendar; the calendar bounds are scalar subqueries (no cross
   join, no calendar table, no key x month join).
4. The long form is ``posexplode`` of the dense array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medspark.functions.scalars import month_start
from medspark.operators.windows import stable


def _cols(cs: str | Sequence[str]) -> list[str]:
    return [cs] if isinstance(cs, str) else list(cs)


def monthly_sum(df: DataFrame, keys: str | Sequence[str], date_col: str, value: str,
                month_col: str = "year_month") -> DataFrame:
    """Floor to month and sum per (key, month) - one row per key and month."""
    return (df.groupBy(*_cols(keys), month_start(date_col).alias(month_col))
            .agg(F.sum(value).alias(value)))


def calendar_bounds(df: DataFrame, month_col: str) -> tuple[Column, Column]:
    """Global first and last month as scalar-subquery columns."""
    return df.agg(F.min(month_col)).scalar(), df.agg(F.max(month_col)).scalar()


def _sparse(df: DataFrame, keys: list[str], month_col: str, value: str, fill,
            materialise: bool) -> tuple[DataFrame, Column, Column]:
    """Per key: ``_s``, its observed months, and ``_n``, the calendar's length; the
    dense array over the global calendar, made from both, and the first month.

    The input feeds two branches (global bounds, per-key gather); with
    ``materialise`` it is checkpointed once so the upstream plan (e.g. a scan
    and aggregate of the fact table) is not executed per branch.
    """
    # a row without a month has no place on the calendar (tsibble rejects it)
    df = df.select(*keys, month_col, value).where(F.col(month_col).isNotNull())
    if materialise:
        df = stable(df)
    lo, hi = calendar_bounds(df, month_col)
    idx = F.months_between(F.col(month_col), lo).cast("int")
    sparse = (df.select(*keys, idx.alias("i"), F.col(value).alias("v"))
              .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_s"))
              .withColumn("_n", F.months_between(hi, lo).cast("int") + 1))
    fill_col = F.lit(fill)
    if fill is None:
        fill_col = fill_col.cast(dict(df.dtypes)[value])
    prev = F.concat(F.array(F.lit(-1)), F.slice(F.col("_s.i"), 1, F.size("_s") - 1))
    pieces = F.zip_with("_s", prev, lambda e, p: F.concat(F.array_repeat(fill_col, e["i"] - p - 1),
                                                          F.array(e["v"])))
    tail = F.array_repeat(fill_col, F.col("_n") - 1 - F.element_at(F.col("_s.i"), -1))
    return sparse, F.concat(F.flatten(pieces), tail), lo


def trend_array(df: DataFrame, keys: str | Sequence[str], month_col: str, value: str,
                out: str = "trend", fill: float = 0.0, total: str | None = None,
                n_positive: str | None = None, materialise: bool = True,
                lookups: Sequence[tuple[DataFrame, str]] = ()) -> DataFrame:
    """R6 + A18: one row per key with the month-ordered, gap-filled value array.

    ``df`` must hold at most one row per (key, month); use ``monthly_sum``.
    ``lookups`` ``(table, key)`` are left-joined (J4) while a row still holds the
    observed months alone: the joins never shuffle or sort arrays of the whole calendar.
    Optional ``total`` (X19, the array's sum) and ``n_positive`` (X20, its
    count of entries > 0) are computed from the observed months only - the
    filled zeros add nothing to either.
    """
    keys = _cols(keys)
    if fill != 0.0 and (total or n_positive):
        raise ValueError("total / n_positive from the sparse months need fill = 0")
    sparse, dense, _ = _sparse(df, keys, month_col, value, fill, materialise)
    made = [dense.alias(out)]
    if total:
        made.append(F.aggregate("_s.v", F.lit(0.0), lambda a, x: a + x).alias(total))
    if n_positive:
        made.append(F.size(F.filter("_s.v", lambda x: x > 0)).alias(n_positive))
    for table, key in lookups:
        sparse = sparse.join(table, key, "left")
    names = sparse.columns
    at = names.index("_s")
    return sparse.select(*names[:at], *made, *names[at + 2:])


def fill_calendar(df: DataFrame, keys: str | Sequence[str], month_col: str, value: str,
                  fill: float | None = 0.0, materialise: bool = True) -> DataFrame:
    """Long form, one row per observed key and calendar month.

    ``df`` must hold at most one row per (key, month); use ``monthly_sum``.
    ``fill=None`` leaves new months missing (input for ``locf``).
    """
    keys = _cols(keys)
    sparse, dense, lo = _sparse(df, keys, month_col, value, fill, materialise)
    return (sparse.select(*keys, F.posexplode(dense).alias("_pos", value))
            .select(*keys, F.add_months(lo, F.col("_pos")).alias(month_col), value))


def ordered_list(df: DataFrame, keys: str | Sequence[str], order: str, value: str,
                 out: str) -> DataFrame:
    """A18 without filling: values per key as an array sorted by ``order``.

    Use on input already reduced to one row per (key, order) so the list
    length is bounded by the number of distinct ``order`` values.
    """
    keys = _cols(keys)
    return (df.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value)))).alias("_s"))
            .select(*keys, F.col("_s").getField(value).alias(out)))

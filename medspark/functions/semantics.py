"""Missing-value and arithmetic rules.

The analyses this library re-implements were written against R semantics
(a sum is missing as soon as one input is missing, NA joins NA, ...) and
against warehouse SQL (sums skip NULL).  Each helper states which rule it
implements so a caller picks the behaviour explicitly.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

MISSING_LABEL = "(Missing)"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- aggregates ------------------------------------------------------------

def sum_strict(c: Column | str) -> Column:
    """NULL as soon as one value in the group is NULL (R ``sum(x)``)."""
    c = _c(c)
    return F.when(F.count(F.lit(1)) == F.count(c), F.sum(c))


def sum_na_rm(c: Column | str) -> Column:
    """Skip NULLs; an all-NULL group sums to 0 (R ``sum(x, na.rm=TRUE)``)."""
    return F.coalesce(F.sum(_c(c)), F.lit(0))


def sum_sql(c: Column | str) -> Column:
    """SQL ``SUM`` - skips NULLs, NULL for an all-NULL group."""
    return F.sum(_c(c))


def agg_sum(c: Column | str, na_rm: bool) -> Column:
    """``sum_na_rm`` when ``na_rm`` else ``sum_strict``."""
    return sum_na_rm(c) if na_rm else sum_strict(c)


def to_units(c: Column | str, scale: float = 1e6) -> Column:
    """Fixed-point quantity: ``floor(x * scale + 0.5)`` as BIGINT.

    Sums of doubles depend on summation order, which changes with the
    partitioning, AQE's plan or a retried task; sums of these integers are
    exact and identical on every run.  Divide by ``scale`` for output.
    """
    return F.floor(_c(c) * F.lit(scale) + F.lit(0.5)).cast("bigint")


_LOW = (1 << 32) - 1


def exact_sum(c: Column | str, na_rm: bool) -> Column:
    """Sum of BIGINT values as DECIMAL(38,0), right beyond 64 bits.

    Each value is split into a high and a low part of 32 bits; the two BIGINT sums
    stay compiled and can not overflow below 2^31 rows a group, whose total they
    give exactly.  Sums of DECIMAL(38,0) values need no parts: use ``agg_sum``.
    """
    c = _c(c)
    high, low = F.sum(F.shiftright(c, 32)), F.sum(c.bitwiseAND(F.lit(_LOW)))
    total = high.cast("decimal(19,0)") * F.lit(_LOW + 1).cast("decimal(10,0)") + low.cast("decimal(19,0)")
    total = total.cast("decimal(38,0)")
    if na_rm:
        return F.coalesce(total, F.lit(0).cast("decimal(38,0)"))
    return F.when(F.count(F.lit(1)) == F.count(c), total)


def count_distinct_na(c: Column | str) -> Column:
    """Distinct count where NULL counts as one more value."""
    c = _c(c)
    return F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))


def first_by(value: Column | str, order: Column | str) -> Column:
    """Deterministic "first" value - the one with the smallest ``order``."""
    return F.min_by(_c(value), _c(order))


# --- window forms ----------------------------------------------------------

def running(w: WindowSpec) -> WindowSpec:
    """ROWS frame from the partition start to the current row."""
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def window_sum(c: Column | str, w: WindowSpec, na_rm: bool) -> Column:
    """N1/N2 over a window: strict (NULL if any NULL in frame) or skipping."""
    c = _c(c)
    if na_rm:
        return F.coalesce(F.sum(c).over(w), F.lit(0))
    return F.when(F.count(F.lit(1)).over(w) == F.count(c).over(w), F.sum(c).over(w))


def cumsum_strict(c: Column | str, w: WindowSpec) -> Column:
    """Running sum that stays NULL from the first NULL on (R ``cumsum``)."""
    return window_sum(c, running(w), na_rm=False)


def dense_rank_na_last(w_order: WindowSpec, value: Column | str) -> Column:
    """``dense_rank`` that leaves NULL values unranked."""
    return F.when(_c(value).isNotNull(), F.dense_rank().over(w_order))


# --- scalar rules ----------------------------------------------------------

def safe_div(a: Column | str, b: Column | str) -> Column:
    """Division that yields NULL for a zero or NULL divisor (no ANSI error)."""
    return F.try_divide(_c(a), _c(b))


def round_half_even(c: Column | str, digits: int) -> Column:
    """R's ``round`` rounds ties to even - Spark ``bround``."""
    return F.bround(_c(c), digits)


def explicit_missing(c: Column | str, label: str = MISSING_LABEL) -> Column:
    """Make a missing category explicit (``fct_explicit_na``)."""
    return F.coalesce(_c(c), F.lit(label))


def blank_to_null(c: Column | str) -> Column:
    """An empty string read from text means missing."""
    return F.nullif(_c(c), F.lit(""))


def nan_to_null(c: Column | str) -> Column:
    """NaN is treated as missing."""
    c = _c(c)
    return F.when(~F.isnan(c), c)


def null_safe_condition(left_cols: Iterable[Column], right_cols: Iterable[Column],
                        null_safe: bool) -> Column:
    """AND of key equalities, ``<=>`` when NA should match NA."""
    conds = [lc.eqNullSafe(rc) if null_safe else lc == rc
             for lc, rc in zip(left_cols, right_cols, strict=True)]
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out

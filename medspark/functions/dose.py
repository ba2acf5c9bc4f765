"""X11: conversion of issued quantities into defined daily doses.

volume_singles     = quantity / unit_dose_form_size
volume_mg_strength = volume_singles * (numerator            if denominator is missing
                                       numerator * (udfs / denominator) otherwise)
volume_ddd         = volume_mg_strength / ddd

Every division is ANSI-safe: a zero divisor gives NULL rather than an error
(N6), and any missing input propagates as NULL.

Volumes are linear in the quantity, so a product has one factor: daily doses for
one unit of quantity.  In fixed point (thousandths of a unit, billionths of a dose)
volumes are whole numbers, ``quantity * factor``, and adding them up is exact and
may come before or after the multiplication: a report gives the same totals from
activity rows as from quantities summed by product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medspark.functions.semantics import to_units

# --- fixed values -----------------------------------------------------------
# Milligrams per defined daily dose by moiety, for the biologic medicines whose
# DDD is looked up by moiety rather than by product.
MOIETY_MG_PER_DDD: list[tuple[str, float]] = [
    ("Omalizumab", 16.0),
    ("Mepolizumab", 3.6),
    ("Reslizumab", 7.1),
    ("Benralizumab", 0.54),
]
# ---------------------------------------------------------------------------


QUANTITY_SCALE = 1000  # fixed-point steps of a unit of quantity
FACTOR_SCALE = 1_000_000_000  # of a daily dose for one unit
UNITS_PER_MICRO = QUANTITY_SCALE * FACTOR_SCALE // 1_000_000


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def volume_singles(quantity: Column | str, udfs: Column | str) -> Column:
    return F.try_divide(_c(quantity), _c(udfs))


def strength_per_single(udfs: Column | str, numerator: Column | str,
                        denominator: Column | str) -> Column:
    num, den = _c(numerator), _c(denominator)
    return F.when(den.isNull(), num).otherwise(num * F.try_divide(_c(udfs), den))


def volume_mg(quantity: Column | str, udfs: Column | str, numerator: Column | str,
              denominator: Column | str) -> Column:
    return volume_singles(quantity, udfs) * strength_per_single(udfs, numerator, denominator)


def volume_ddd(quantity: Column | str, udfs: Column | str, numerator: Column | str,
               denominator: Column | str, ddd: Column | str) -> Column:
    return F.try_divide(volume_mg(quantity, udfs, numerator, denominator), _c(ddd))


def dose_factor(udfs: Column | str, numerator: Column | str, denominator: Column | str, ddd: Column | str) -> Column:
    """Daily doses for one unit of quantity, in steps of 1 / ``FACTOR_SCALE`` (BIGINT)."""
    return to_units(volume_ddd(F.lit(1.0), udfs, numerator, denominator, ddd), FACTOR_SCALE)


def quantity_units(quantity: Column | str) -> Column:
    """A quantity in steps of 1 / ``QUANTITY_SCALE`` (BIGINT)."""
    return to_units(quantity, QUANTITY_SCALE)


def dose_units(quantity: Column | str, factor: Column | str) -> Column:
    """Fixed-point quantity times factor: an exact volume, DECIMAL(38,0)."""
    return (_c(quantity).cast("decimal(28,0)") * _c(factor).cast("decimal(19,0)")).cast("decimal(38,0)")


def micro_ddd(units: Column | str) -> Column:
    """Whole millionths of a daily dose (truncated) in an exact volume, DECIMAL(38,0)."""
    u, step = _c(units), F.lit(UNITS_PER_MICRO).cast("decimal(7,0)")
    return ((u - u % step) / step).cast("decimal(38,0)")


def moiety_ddd_table(spark: SparkSession, rows: list[tuple[str, float]] | None = None) -> DataFrame:
    """``(vtmnm, mg_per_ddd)`` as a broadcast inline lookup."""
    data = MOIETY_MG_PER_DDD if rows is None else rows
    from medspark.sources.literals import literal_table
    return F.broadcast(literal_table(spark, data, "vtmnm string, mg_per_ddd double"))

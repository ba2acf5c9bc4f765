"""Scalar column helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def title_case(c: Column | str) -> Column:
    """Capitalise the first letter of each blank-separated word."""
    return F.initcap(_c(c))


def replace_first(c: Column | str, find: str, repl: str) -> Column:
    """Replace only the FIRST occurrence of a literal (``str_replace``)."""
    pattern = "^(.*?)" + re.escape(find)
    return F.regexp_replace(_c(c), pattern, "$1" + repl.replace("$", "\\$"))


def parse_digits_date(c: Column | str, fmt: str = "yyyyMMdd") -> Column:
    """Parse a date from text; unparsable text gives NULL, not an error."""
    return F.try_to_date(_c(c).cast("string"), fmt)


def in_months(date: str, start: str, end: str) -> Column:
    """F4 on the raw date or timestamp column: the closed range of months as
    ``date >= start AND date < the month after end``, which reaches the scan."""
    day = F.col(date)
    return (day >= F.to_timestamp_ntz(F.lit(start))) & (
        day < F.add_months(F.to_date(F.lit(end)), 1).cast("timestamp_ntz"))


def month_start(c: Column | str) -> Column:
    """Floor a date or timestamp to the first day of its month."""
    return F.trunc(_c(c).cast("date"), "month")


def month_label(c: Column | str) -> Column:
    """Abbreviated English month name ("Jan")."""
    return F.date_format(_c(c), "MMM")


def thousands(c: Column | str) -> Column:
    """Whole number with thousands separators, from a rounded BIGINT."""
    return F.format_number(F.round(_c(c)).cast("bigint"), 0)


def percent_1dp(c: Column | str) -> Column:
    """Share as "12.3%", built from the rounded per-mille integer."""
    permille = F.round(_c(c) * 1000).cast("bigint")
    sign = F.when(permille < 0, F.lit("-")).otherwise(F.lit(""))
    a = F.abs(permille)
    return F.concat(sign, F.floor(a / 10).cast("bigint").cast("string"), F.lit("."),
                    (a % 10).cast("string"), F.lit("%"))


def code_label(prefix: str, c: Column | str, unknown: str = "Unknown") -> Column:
    """X6: "<prefix><code>", or ``unknown`` when the code is missing."""
    c = _c(c)
    return F.when(c.isNull(), F.lit(unknown)).otherwise(F.concat(F.lit(prefix), c.cast("string")))


def extract_after(c: Column | str, prefix: str) -> Column:
    """Letters following ``prefix`` (look-behind extract)."""
    return F.regexp_extract(_c(c), re.escape(prefix) + "([A-Za-z]+)", 1)


def if_missing(test: Column | str, when_missing: Column, otherwise: Column) -> Column:
    """``if_else(is.na(test), a, b)``."""
    return F.when(_c(test).isNull(), when_missing).otherwise(otherwise)


def availability_flag(c: Column | str) -> Column:
    """X17: "TRUE"/"FALSE" for present/missing (the factor of ``!is.na(x)``)."""
    return F.when(_c(c).isNotNull(), F.lit("TRUE")).otherwise(F.lit("FALSE"))


def sign_label(c: Column | str) -> Column:
    """Two-level sign factor: ``>= 0`` is "Positive", else "Negative"."""
    c = _c(c)
    return F.when(c >= 0, F.lit("Positive")).when(c < 0, F.lit("Negative"))


def zero_unless(cond: Column, value: Column | str) -> Column:
    """The value where ``cond`` holds, else 0."""
    return F.when(cond, _c(value)).otherwise(F.lit(0.0))


def array_total(arr: Column | str) -> Column:
    """Sum of a numeric array (``sum(unlist(x))``); NULL entries propagate."""
    return F.aggregate(_c(arr), F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def count_positive(arr: Column | str) -> Column:
    """Number of strictly positive entries of an array."""
    return F.size(F.filter(_c(arr), lambda x: x > 0))


def snake_case(name: str) -> str:
    """Normalise a column name to lower snake case (``clean_names``)."""
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip())
    s = re.sub(r"[^0-9A-Za-z]+", "_", s).strip("_").lower()
    if not s:
        s = "x"
    if s[0].isdigit():
        s = "x" + s
    return s


def snake_case_names(names: list[str]) -> list[str]:
    """P7 for a whole header: snake case, duplicates made unique with _2, _3."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        s = snake_case(n)
        if s in seen:
            seen[s] += 1
            s = f"{s}_{seen[s]}"
        else:
            seen[s] = 1
        out.append(s)
    return out

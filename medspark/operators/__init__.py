"""Relational operators; each takes and returns DataFrames."""

from medspark.operators import (activity, calendar, codelists, columns, dictionary, joins, organisations,
                                quality, reshape, windows)

__all__ = ["activity", "calendar", "codelists", "columns", "dictionary", "joins", "organisations", "quality",
           "reshape", "windows"]

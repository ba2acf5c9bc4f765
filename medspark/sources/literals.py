"""Inline literal tables (override maps, dose tables, typed-in code lists).

The Python values become Arrow arrays of the declared types, which Spark takes as
a local relation with a known size; one path for every number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: StructType | str) -> DataFrame:
    """A table of literal rows with the given schema (DDL or StructType)."""
    st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(st)
    columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
    return spark.createDataFrame(table, st)

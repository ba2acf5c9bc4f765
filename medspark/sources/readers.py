"""Readers and writers.

Types are never inferred: every text source takes an explicit schema, so
product ids of 15-18 digits stay text and a damaged file cannot silently
change a column's type.  Text reads use ``FAILFAST`` by default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StringType, StructField, StructType

from medspark.functions.scalars import snake_case_names

# The dose file: BNF_DETAILS/VMPS/VMP rows, every field but VPID optional.
DOSE_XML_SCHEMA = StructType([
    StructField("VPID", StringType(), True),
    StructField("BNF", StringType(), True),
    StructField("ATC", StringType(), True),
    StructField("DDD", DecimalType(18, 4), True),
    StructField("DDD_UOMCD", StringType(), True),
])
DOSE_SENTINEL = "n/a"


def _blank_strings_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.nullif(F.col(f.name), F.lit("")).alias(f.name)
                       if isinstance(f.dataType, StringType) else F.col(f.name)
                       for f in df.schema.fields])


def read_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True,
             null_value: str = "NA", blank_is_missing: bool = True, mode: str = "FAILFAST") -> DataFrame:
    """CSV with header and an explicit schema.

    N12: ``NA`` and (by default) empty text both mean missing, like
    ``readr::read_csv``; ``blank_is_missing=False`` keeps the blanks of text columns,
    quoted or not, as "", as base R does (blank numbers are missing there too).
    """
    if not blank_is_missing:
        return _read_csv_keeping_blanks(spark, path, schema, header, null_value, mode)
    return _blank_strings_to_null(_csv(spark, path, schema, header, null_value, mode))


def _csv(spark: SparkSession, path: str, schema: StructType | str, header: bool, null_value: str,
         mode: str) -> DataFrame:
    return (spark.read.schema(schema).option("header", header).option("nullValue", null_value)
            .option("mode", mode).option("quote", '"').option("escape", '"').csv(path))


def _read_csv_keeping_blanks(spark: SparkSession, path: str, schema: StructType | str, header: bool,
                             null_value: str, mode: str) -> DataFrame:
    """Spark reads an unquoted blank as its null mark.  So all columns are read as
    text with a mark that no file has, and NULL is a blank again."""
    fields = (schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).fields
    texts = StructType([StructField(f.name, StringType(), True) for f in fields])
    df = _csv(spark, path, texts, header, "\x00", mode)

    def value(f: StructField):
        text = F.nullif(F.coalesce(F.col(f.name), F.lit("")), F.lit(null_value))
        return text if isinstance(f.dataType, StringType) else F.nullif(text, F.lit("")).cast(f.dataType)

    return df.select(*[value(f).alias(f.name) for f in fields])


def read_csv_positional(spark: SparkSession, path: str, names: Sequence[str], keep: int | None = None,
                        null_value: str = "NA", blank_is_missing: bool = True,
                        mode: str = "PERMISSIVE") -> DataFrame:
    """Headerless CSV, columns named by position, optionally only the first ``keep``.

    All columns are read as text (the register files hold codes and
    ``yyyymmdd`` dates); callers cast what they need.  PERMISSIVE by default:
    a file may carry fewer trailing columns than names (they read as NULL).
    """
    schema = StructType([StructField(n, StringType(), True) for n in names])
    df = read_csv(spark, path, schema, header=False, null_value=null_value,
                  blank_is_missing=blank_is_missing, mode=mode)
    return df.select(*names[:keep]) if keep else df


def read_csv_clean_names(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """S3 + P7: header CSV whose columns are then renamed to snake case."""
    return read_csv(spark, path, schema).toDF(*snake_case_names(schema.fieldNames()))


def write_csv(df: DataFrame, path: str, null_value: str = "NA", quote_all: bool = False,
              header: bool = True, mode: str = "overwrite") -> None:
    """CSV sink (one folder of part files; missing written as ``NA``)."""
    (df.write.mode(mode).option("header", header).option("nullValue", null_value)
     .option("quoteAll", quote_all).option("escape", '"').csv(path))


def read_dose_xml(spark: SparkSession, path: str, row_tag: str = "VMP",
                  schema: StructType = DOSE_XML_SCHEMA, sentinel: str = DOSE_SENTINEL) -> DataFrame:
    """One row per ``row_tag`` element; absent elements and the
    ``n/a`` sentinel become NULL.  The XML source splits large files, so the
    read is distributed (no whole-tree parse on one machine)."""
    df = (spark.read.format("xml").option("rowTag", row_tag).option("nullValue", sentinel)
          .option("mode", "FAILFAST").schema(schema).load(path))
    return df.select(*[F.when(F.col(f.name).cast("string") == F.lit(sentinel), F.lit(None))
                       .otherwise(F.col(f.name)).alias(f.name) for f in schema.fields])


def write_xml(df: DataFrame, path: str, row_tag: str = "VMP", root_tag: str = "VMPS",
              sentinel: str | None = DOSE_SENTINEL, mode: str = "overwrite") -> None:
    """S7 for XML: rows as ``row_tag`` elements under ``root_tag``; NULL fields
    are written as the sentinel (or omitted when ``sentinel`` is None)."""
    w = df.write.mode(mode).format("xml").option("rowTag", row_tag).option("rootTag", root_tag)
    if sentinel is not None:
        w = w.option("nullValue", sentinel)
    w.save(path)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Columnar source: only the selected columns are read (``ReadSchema``)."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ("year_month",),
                  mode: str = "overwrite") -> None:
    """Columnar sink laid out by month: a later month-range filter on
    ``year_month`` prunes whole folders (``PartitionFilters``) before any file
    is opened, and column pruning reads only the selected columns."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)

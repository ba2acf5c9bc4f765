"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1000  # that Python takes at once
ROW_GROUP_BYTES = 16 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the folder that the context was
    given; a folder below the warehouse only on a local master where both are unset.
    Elsewhere that is an error: a machine's own folder isn't shared."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set; point it at shared storage")
        root = spark.conf.get("spark.sql.warehouse.dir") + "/llm-shared"
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written once as Parquet and read back: cuts the lineage, survives
    lost executors, gives the planner real sizes.

    A row may hold a whole text, or two: row groups are small, and few rows at a
    time go to Python while ``df`` is computed."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A form of ``written`` for tables that are read only inside the block, which
    deletes them at its end."""
    folder = new_path(spark, "scratch")

    def keep(df: DataFrame, name: str) -> DataFrame:
        return written(df, name, f"{folder}/{name}-{uuid.uuid4().hex}")

    try:
        yield keep
    finally:
        root = spark._jvm.org.apache.hadoop.fs.Path(folder)
        root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)

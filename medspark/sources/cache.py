"""Materialisation: read-through results kept in shared storage.

``materialised(spark, name, params, build)`` writes ``build()`` once as
parquet below the cluster's checkpoint folder, under a key derived from the
name AND the parameters (distinct queries never share a path), and reads it
back on every later call.  Unlike ``cache()``, the written copy survives
executor loss and later sessions.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medspark.session import checkpoint_root
from medspark.sources.literals import literal_table

_SCOPE: ContextVar[str | None] = ContextVar("copies", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The configured ``spark.checkpoint.dir`` (or the context's checkpoint dir)."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    return (conf or checkpoint_root(spark)).rstrip("/")


def cache_key(name: str, params: Mapping) -> str:
    digest = hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()
    return f"{name}-{digest[:20]}"


def source_version(spark: SparkSession, *paths: str) -> str:
    """A digest of the files below ``paths`` (names, sizes, times), for ``params``:
    a source that was written anew gets a new copy.  The files are listed, not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
             .select(F.xxhash64("path", "length", F.col("modificationTime").cast("double")).alias("h")))
    row = files.agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("h")).first()
    return f"{row['n']}-{row['h']}"


def materialised(spark: SparkSession, name: str, params: Mapping, build: Callable[[], DataFrame],
                 refresh: bool = False) -> DataFrame:
    """Read-through parquet copy of ``build()`` keyed by name + params."""
    path = f"{shared_folder(spark)}/medspark-materialised/{cache_key(name, params)}"
    if not refresh and _committed(spark, path):
        return spark.read.parquet(path)
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def materialised_by_month(spark: SparkSession, name: str, params: Mapping, versions: Mapping[str, str],
                          build: Callable[[list[str]], DataFrame], month: str = "year_month") -> DataFrame:
    """S8 for a result that grows by the month: only changed months are built anew.

    ``versions`` names the wanted months ("2020-03-01") and the state of each one's
    source (``source_version`` of its folder, say).  ``build(months)`` gives the rows of
    some months.  The copy is partitioned by month; a list of what was stored, written
    last, makes an interrupted renewal start again.  Months that are no longer wanted,
    or have no rows any more, go.
    """
    path = f"{shared_folder(spark)}/medspark-materialised/{cache_key(name, params)}-monthly"
    listed = f"{path}.versions"
    known = {r["month"]: r["version"] for r in spark.read.parquet(listed).collect()} if _committed(spark, listed) else {}
    changed = sorted(m for m, v in versions.items() if known.get(m) != v)
    gone = set(known) - set(versions)
    if changed or gone:
        kept = [(m, v) for m, v in known.items() if m in versions and m not in changed]
        _listed(spark, listed, kept)  # what is about to change doesn't count as stored
        for m in [*changed, *gone]:
            delete_folder(spark, f"{path}/{month}={m}")
        if changed:
            (build(changed).where(F.col(month).cast("string").isin(changed)).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path))
        _listed(spark, listed, list(versions.items()))
    return spark.read.parquet(path)


def _listed(spark: SparkSession, path: str, rows: list[tuple[str, str]]) -> None:
    literal_table(spark, rows, "month string, version string").coalesce(1).write.mode("overwrite").parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of stored results, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def copies(spark: SparkSession) -> Iterator[None]:
    """The life of written copies.  Operators that read one result in several
    branches write it once (``windows.stable``); copies written inside this block are
    deleted at its end, so results that read them must be used or stored inside."""
    folder = f"{shared_folder(spark)}/medspark-copies/{uuid.uuid4().hex}"
    token = _SCOPE.set(folder)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        delete_folder(spark, folder)


def copy_path(spark: SparkSession) -> str:
    """A new path for a written copy: in the innermost block of ``copies``, if any."""
    return f"{_SCOPE.get() or shared_folder(spark) + '/medspark-stable'}/{uuid.uuid4().hex}"


def _committed(spark: SparkSession, path: str) -> bool:
    """True when a completed write left its ``_SUCCESS`` marker: a folder from
    a write that died with its job (lost driver, killed application) is
    rebuilt rather than read half-written."""
    try:
        spark.read.format("text").load(f"{path}/_SUCCESS")
        return True
    except AnalysisException:
        return False

"""Session construction and the shared checkpoint folder.

Library code never invents storage locations on a cluster: lineage cuts and
materialised results go below the folder the cluster names in
``spark.checkpoint.dir``.  Only a local-mode session (tests, bench) may fall
back to a folder below its warehouse when nothing is configured.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "medspark") -> SparkSession:
    """Session for tests, bench and local runs (AQE on, UI off, UTC)."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # local data is small: keep post-shuffle stages parallel (AQE's default
        # 1 MB minimum would merge a CPU-heavy stage into one task)
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize",
                os.environ.get("MEDSPARK_MIN_PARTITION_SIZE", "64k"))
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # the activity aggregate is keyed by (month, organisation, product) with
        # few duplicate keys: the single-level partial-aggregate map is faster
        .config("spark.sql.codegen.aggregate.map.twolevel.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("MEDSPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, configuring it only when unset.

    Order: the SparkContext's checkpoint dir, then ``spark.checkpoint.dir``;
    with neither set, a local-mode session gets a folder below its warehouse and
    any other master raises, because a machine-local folder is not shared.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at shared storage")
        conf_dir = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/medspark-shared"
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()

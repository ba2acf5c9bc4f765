"""Intermediate tables: where they lie, and how long."""

import glob

import pytest

from medspark.llm import near_dups, storage


def folders(spark):
    return set(glob.glob(storage.shared_folder(spark).removeprefix("file:") + "/llm-*"))


def test_scratch_tables_end_with_their_block(spark):
    before = folders(spark)
    with pytest.raises(RuntimeError), storage.scratch(spark) as keep:
        assert keep(spark.range(5), "a").count() == 5 and keep(spark.range(0), "b").count() == 0
        assert len(folders(spark) - before) == 1
        raise RuntimeError
    assert folders(spark) == before


def test_near_duplicates_leave_what_their_result_reads(spark, odd):
    before = folders(spark)
    rows = near_dups.near_duplicates(odd)
    kinds = sorted(p.rsplit("/llm-", 1)[1].rsplit("-", 1)[0] for p in folders(spark) - before)
    assert set(kinds) == {"signatures", "sets", "components"} and rows.count() == odd.count()


def test_batches_are_as_before_after_a_table_is_written(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    storage.written(spark.range(3), "x")
    assert spark.conf.get(key) == old


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return self.folder

    class Session:
        sparkContext = Context()
        conf = {}

    Session.sparkContext.folder = None
    with pytest.raises(RuntimeError):
        storage.shared_folder(Session)
    Session.sparkContext.folder = "hdfs://x/y/"
    assert storage.shared_folder(Session) == "hdfs://x/y"
    Session.conf = {"spark.checkpoint.dir": "s3://b/c"}
    assert storage.shared_folder(Session) == "s3://b/c"

"""Renewal of stored results by month, and the life of written copies."""

import datetime as dt
import glob

from pyspark.sql import functions as F

from medspark.operators import windows
from medspark.sources import cache


def test_only_changed_months_are_built(spark, tmpdir_path):
    built = []
    rows = {"2020-01-01": 1.0, "2020-02-01": 2.0, "2020-03-01": 3.0}

    def build(months):
        built.append(list(months))
        return spark.createDataFrame([(dt.date.fromisoformat(m), rows[m]) for m in months if m in rows],
                                     "year_month date, q double")

    def get(versions):
        df = cache.materialised_by_month(spark, "monthly", {"at": tmpdir_path}, versions, build)
        return {str(r["year_month"]): r["q"] for r in df.collect()}

    versions = {m: "v1" for m in rows}
    assert get(versions) == rows and get(versions) == rows and built == [sorted(rows)]
    rows["2020-02-01"] = 20.0
    assert get(versions | {"2020-02-01": "v2"}) == rows and built[1:] == [["2020-02-01"]]
    versions["2020-02-01"] = "v2"
    rows["2020-04-01"] = 4.0
    assert get(versions | {"2020-04-01": "v1"}) == rows and built[2:] == [["2020-04-01"]]
    del rows["2020-01-01"]  # a month that isn't wanted any more, and one that lost its rows
    del rows["2020-03-01"]
    assert get({"2020-02-01": "v2", "2020-03-01": "v2", "2020-04-01": "v1"}) == rows and built[3:] == [["2020-03-01"]]


def test_an_interrupted_renewal_starts_again(spark, tmpdir_path):
    def build(months):
        return spark.createDataFrame([(m, 1) for m in months], "year_month string, q int")

    def fail(months):
        raise RuntimeError("lost")

    def get(versions, make):
        return cache.materialised_by_month(spark, "again", {"at": tmpdir_path}, versions, make).count()

    assert get({"2020-01-01": "a", "2020-02-01": "a"}, build) == 2
    try:
        get({"2020-01-01": "a", "2020-02-01": "b"}, fail)
    except RuntimeError:
        pass
    assert get({"2020-01-01": "a", "2020-02-01": "a"}, build) == 2  # the month of the failed renewal is built anew


def test_copies_end_with_their_block(spark):
    folder = f"{cache.shared_folder(spark)}/medspark-copies".removeprefix("file:")
    before = set(glob.glob(f"{folder}/*"))
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, v double")
    with cache.copies(spark):
        scaled = windows.minmax_scale(df, "v", "s")
        assert len(set(glob.glob(f"{folder}/*")) - before) == 1
        with cache.copies(spark):
            assert windows.stable(df.select(F.max("v"))).count() == 1
        assert {r["s"] for r in scaled.collect()} == {0.0, 1.0}
    assert set(glob.glob(f"{folder}/*")) == before

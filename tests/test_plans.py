"""Plan-shape guards for the scale design (read from the physical plans).

* no registered query contains a cartesian product or a nested-loop join;
* a table codelist is applied below the activity aggregate, at the scan;
* the fact table is partially aggregated before its first shuffle;
* every single-partition exchange carries only bounded data (partial global
  aggregates or per-partition counts), never raw rows;
* a key holding a third of all rows gives the same results as the oracle.
"""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from medspark.plans import catalog
from medspark.sources import testdata as td

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _final(plan: str) -> str:
    """Only the '== Final Plan ==' part of an executed adaptive plan."""
    if "== Final Plan ==" in plan:
        plan = plan.split("== Final Plan ==", 1)[1].split("== Initial Plan ==", 1)[0]
    return plan


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _plan(queries()[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_codelist_filter_reaches_the_scan(spark):
    plan = _plan(catalog._codelist_activity(spark, SF))
    # the semi join sits below the first partial aggregate of lineitem
    semi = plan.find("LeftSemi")
    assert semi != -1
    first_partial = plan.rfind("partial_sum")
    assert first_partial != -1 and semi > first_partial


def test_fact_table_partially_aggregated_before_shuffle(spark):
    plan = _plan(td.activity(spark, SF))
    assert re.search(r"HashAggregate\(keys=.*functions=\[partial_sum", plan)


def test_single_partition_exchanges_are_bounded(spark):
    for name in ("category_order", "trust_rank", "profile_activity", "gap_fill"):
        df = queries()[name](spark, SF)
        df.collect()  # finalises the adaptive plan
        plan = _final(df._jdf.queryExecution().executedPlan().toString())
        for m in re.finditer(r"Exchange SinglePartition[^\n]*\n(.*\n){0,3}", plan):
            block = m.group(0)
            assert ("partial_" in block or "_pid" in block or "HashAggregate" in block
                    or "TakeOrderedAndProject" in block), (name, block)


def test_hot_key_third_of_rows(spark):
    """One organisation carries a third of all activity rows; reports stay exact."""
    from medspark.operators import calendar
    from medspark.plans import reports
    base = td.activity(spark, SF)
    n = base.count()
    hot = base.limit(n // 2).withColumn("ods_code", F.lit(-1).cast("long"))
    df = base.unionByName(hot)
    shares = reports.category_shares(df.withColumn("g", F.col("ods_code") % 3), "ods_code", "g",
                                     "total_quantity", na_rm=True)
    tot = {r["ods_code"]: r["total"] for r in shares.where("ods_code = -1").collect()}
    expected = df.where("ods_code = -1").agg(F.sum("total_quantity")).first()[0]
    assert tot[-1] == expected
    monthly = df.groupBy("ods_code", "year_month").agg(F.sum("total_quantity").alias("q"))
    filled = calendar.fill_calendar(monthly, "ods_code", "year_month", "q")
    months = monthly.select("year_month").distinct()
    lo, hi = monthly.agg(F.min("year_month"), F.max("year_month")).first()
    n_months = (hi.year - lo.year) * 12 + hi.month - lo.month + 1
    assert filled.where("ods_code = -1").count() == n_months
    assert months.count() <= n_months


TWO_SOURCE = {"combined_sources", "source_share", "area_share_pivot"}


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_fact_table_scanned_once_per_source(spark, name):
    """A query reads lineitem at most once per source it needs (the two-source
    reports need it twice); inputs used by two branches are materialised."""
    df = queries()[name](spark, SF)
    df.collect()  # finalises the adaptive plan
    scans = _final(df._jdf.queryExecution().executedPlan().toString()).count("lineitem.parquet")
    assert scans <= (2 if name in TWO_SOURCE else 1), (name, scans)


def test_hot_organisation_join_is_split_by_aqe(spark):
    """With the register too big to broadcast, the fact-to-register join is a
    sort-merge join on the organisation key, and AQE splits the hot key."""
    from medspark.plans import reports
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        act = td.activity(spark, SF)
        n = act.count()
        hot = act.limit(n // 2).withColumn("ods_code", F.lit(7).cast("long"))  # a third of the rows
        fact = act.unionByName(hot)
        out = reports.with_areas(fact, td.orgs(spark, SF), td.areas(spark, SF))
        total = len(out.collect())  # finalises the adaptive plan
        plan = _final(out._jdf.queryExecution().executedPlan().toString())
        assert total == fact.count()
        assert "SortMergeJoin(skew=true)" in plan and "AQEShuffleRead skewed" in plan, plan[:2000]
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_period_reaches_the_scan(spark):
    """The input of the period reports is filtered at the scan of the raw rows."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = _plan(td.volume(spark, SF, catalog.PERIOD))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(l_shipdate,1998-08-01", plan)
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(l_shipdate,1999-08-01", plan)

"""Every registered query against its DuckDB oracle on the smallest tables.

The driver runs the same comparison at sf0.01; sf0.001 keeps the suite fast.
Set MEDSPARK_ORACLE_SF to another folder to run it at a larger scale.
"""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from medspark.plans import catalog
from tools.oracle_compare import compare, duck

SF = os.environ.get("MEDSPARK_ORACLE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, name, SF, con)
    assert res["status"] == "OK", res


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) <= set(oracle_sql()) <= set(queries())


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.columns == ["year_month", "vtmnm", "volume_ddd"]
    assert df.count() > 0

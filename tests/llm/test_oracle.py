"""Queries that SQL can express, against DuckDB on whole tables."""

import pytest

from medspark.llm import queries
from tools.oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_matches_oracle(spark, name):
    res = compare(spark, name, SF, duck(SF))
    assert res["status"] == "OK", res

"""Property tests of the invariants in SURVEY section 5 on random small inputs."""

import datetime as dt
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from medspark.operators import calendar, windows
from medspark.plans import reports

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

cells = st.lists(st.tuples(st.sampled_from(["a", "b", "c", "d"]), st.integers(0, 30),
                           st.integers(-50, 50)), min_size=1, max_size=40)


def _month(i: int) -> dt.date:
    return dt.date(2019 + i // 12, i % 12 + 1, 1)


@SETTINGS
@given(cells)
def test_gap_fill_invariants(spark, data):
    # one row per (key, month): sum duplicates first, as the reports do
    agg: dict[tuple[str, int], float] = {}
    for k, m, v in data:
        agg[(k, m)] = agg.get((k, m), 0.0) + float(v)
    rows = [(k, _month(m), v) for (k, m), v in agg.items()]
    df = spark.createDataFrame(rows, "k string, year_month date, q double")
    out = calendar.fill_calendar(df, "k", "year_month", "q").collect()
    months = [m for _, m in agg]
    n_months = max(months) - min(months) + 1
    keys = {k for k, _ in agg}
    assert len(out) == len(keys) * n_months                      # rows per key = calendar length
    assert math.isclose(sum(r["q"] for r in out), sum(agg.values()))  # filling keeps the total
    got = {(r["k"], r["year_month"]): r["q"] for r in out}
    assert all(got[(k, _month(m))] == v for (k, m), v in agg.items())  # observed values unchanged
    arrays = {r["k"]: r["t"] for r in calendar.trend_array(df, "k", "year_month", "q", "t").collect()}
    for k in keys:
        assert arrays[k] == [got[(k, _month(min(months) + i))] for i in range(n_months)]


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["g1", "g2", "g3"]), st.sampled_from(["x", "y", "z"]),
                          st.integers(1, 1000)), min_size=1, max_size=30))
def test_shares_sum_to_one_per_group(spark, data):
    df = spark.createDataFrame([(g, c, float(v)) for g, c, v in data], "g string, c string, v double")
    out = reports.category_shares(df, "g", "c", "v", na_rm=True).collect()
    per: dict[str, float] = {}
    for r in out:
        per[r["g"]] = per.get(r["g"], 0.0) + r["prop_use"]
        assert r["pos"] <= r["total"]
    assert all(math.isclose(s, 1.0) for s in per.values())


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 5), st.text("ab", min_size=1, max_size=3)), min_size=1, max_size=40,
                unique=True))
def test_global_row_number_is_a_sorted_permutation(spark, data):
    df = spark.createDataFrame(data, "v int, s string").repartition(3)
    out = windows.global_row_number(df, ["v", "s"], "rn").collect()
    assert sorted(r["rn"] for r in out) == list(range(1, len(data) + 1))
    assert [(r["v"], r["s"]) for r in sorted(out, key=lambda r: r["rn"])] == sorted(data)

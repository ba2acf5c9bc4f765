"""Data-quality profiles (SURVEY: A9, A12-A17, A19, A21, Q18, Q19).

The profiles are single aggregations: partial aggregates on every input
partition, one small final merge.  Distinct counts are exact by default;
``approx=True`` switches to HyperLogLog++ (bounded memory per group).
Per-group quantiles (``percentiles_by``) are exact without holding a group
in one task (histograms + order statistics), or approximate on request.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medspark.functions.scalars import availability_flag, sign_label
from medspark.functions.semantics import count_distinct_na, explicit_missing, nan_to_null, safe_div, sum_na_rm
from medspark.operators.joins import join_left
from medspark.operators.windows import stable


def activity_profile(df: DataFrame, date_col: str, org_col: str, product_col: str, value: str,
                     approx: bool = False, dense_ids: bool = False) -> DataFrame:
    """Date range, distinct organisations and products (NA counted,
    N13), and the sums of positive and of negative quantities.

    ``dense_ids``: both keys are integers without large gaps, such as surrogate keys;
    they are then counted exactly with bitmaps, in the same single pass
    (``profile_with_bitmaps``).  Other keys are counted by Spark's distinct
    aggregation, which copies each row for every distinct count."""
    v = F.col(value)
    plain = {"first_month": (F.min, F.col(date_col)), "last_month": (F.max, F.col(date_col)),
             "sum_positive": (F.sum, F.when(v > 0, v)), "sum_negative": (F.sum, F.when(v < 0, v))}
    counts = {"n_ods_codes": org_col, "n_products": product_col}
    names = ["first_month", "last_month", "n_ods_codes", "n_products", "sum_positive", "sum_negative"]
    if dense_ids:
        return profile_with_bitmaps(df, counts, plain).select(*names)
    count = F.approx_count_distinct if approx else count_distinct_na
    return df.agg(*[make(c).alias(n) for n, (make, c) in plain.items()],
                  *[count(c).alias(n) for n, c in counts.items()]).select(*names)


def profile_with_bitmaps(df: DataFrame, counts: Mapping[str, str], plain: Mapping[str, tuple]) -> DataFrame:
    """Exact numbers of distinct integers of several columns (NULL counted, N13),
    beside other aggregates, in one pass that copies no row.

    Integers fall into buckets of 32,768; rows are grouped by the buckets of all the
    columns and each group keeps a bitmap for each column.  The groups, few where
    integers are dense, are then merged bucket by bucket.  ``plain`` names an
    aggregate that merges with itself (min, max, sum) and its argument."""
    ids = {n: F.col(c).cast("bigint") for n, c in counts.items()}
    merges = {n: make for n, (make, _) in plain.items()}
    groups = df.groupBy(*[F.bitmap_bucket_number(c).alias(f"_b_{n}") for n, c in ids.items()]).agg(
        *[F.bitmap_construct_agg(F.coalesce(F.bitmap_bit_position(c), F.lit(0))).alias(f"_m_{n}") for n, c in ids.items()],
        *[make(c).alias(f"_p_{n}") for n, (make, c) in plain.items()])
    # one row per group and column; the other aggregates go with the first column's
    rows = groups.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(f"_b_{n}").alias("bucket"), F.col(f"_m_{n}").alias("bits"),
                 *[F.when(F.lit(i == 0), F.col(f"_p_{p}")).alias(p) for p in plain]) for i, n in enumerate(ids)])))
    merged = rows.groupBy("name", "bucket").agg(
        F.when(F.col("bucket").isNull(), F.lit(1).cast("bigint")).otherwise(F.bitmap_count(F.bitmap_or_agg("bits"))).alias("n"),
        *[make(F.col(p)).alias(p) for p, make in merges.items()])
    return merged.agg(*[F.coalesce(F.sum(F.when(F.col("name") == n, F.col("n"))), F.lit(0)).alias(n) for n in ids],
                      *[make(F.col(p)).alias(p) for p, make in merges.items()])


def distinct_per_period(df: DataFrame, period: str, entity: str, out: str = "n") -> DataFrame:
    """A12 + A9: number of distinct entities (e.g. organisations) per period."""
    return df.select(period, entity).distinct().groupBy(period).agg(F.count(F.lit(1)).alias(out))


def negative_profile(df: DataFrame, by: str | Sequence[str], value: str) -> DataFrame:
    """Rows, negative rows and their share per group."""
    by = [by] if isinstance(by, str) else list(by)
    neg = F.sum(F.when(F.col(value) < 0, 1).otherwise(0))
    return (df.groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n"), neg.alias("n_negative"))
            .withColumn("share_negative", safe_div(F.col("n_negative").cast("double"), F.col("n"))))


def totals_with_flags(df: DataFrame, key: str, value: str, availability: DataFrame, flag_col: str,
                      filters: dict[str, Sequence[str]] | None = None, out: str = "count") -> DataFrame:
    """Q19 (A16 J7 X15 X17 F10): per key the NA-skipping total, the lookup's
    availability flag ("TRUE"/"FALSE", "(Missing)" when the key is not in the
    lookup) and the sign label; ``filters`` are optional value lists per column."""
    totals = df.groupBy(key).agg(sum_na_rm(value).alias(out))
    out_df = (totals.join(availability, key, "left")
              .withColumn(flag_col, explicit_missing(flag_col))
              .withColumn("positive_count", sign_label(out)))
    for c, allowed in (filters or {}).items():
        out_df = out_df.where(F.col(c).isin(list(allowed)))
    return out_df


def availability_table(lookup: DataFrame, key: str, value: str, flag_col: str) -> DataFrame:
    """``(key, "TRUE"/"FALSE")`` for a lookup column (``factor(!is.na(v))``)."""
    return lookup.select(key, availability_flag(value).alias(flag_col))


def column_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per numeric column with count, missing, min, max and mean.

    One aggregation computes every statistic of every column, then a stack
    turns the single wide row long; no per-column job.
    """
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__n"),
                 F.sum(F.when(x.isNull(), 1).otherwise(0)).alias(f"{c}__missing"),
                 F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"),
                 F.avg(x).alias(f"{c}__mean")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("n"),
                     F.col(f"{c}__missing").alias("n_missing"), F.col(f"{c}__min").alias("min"),
                     F.col(f"{c}__max").alias("max"), F.col(f"{c}__mean").alias("mean"))
            for c in cols]
    return wide.select(F.inline(F.array(*rows)))


def percentiles_by(df: DataFrame, by: str | Sequence[str], value: str, probs: Sequence[float],
                   names: Sequence[str], method: str = "distributed", accuracy: int = 10000) -> DataFrame:
    """Per group, quantiles with linear interpolation (R type 7, N14);
    missing values are ignored.  One output row per group, one column per name.

    ``method``:
    * ``"distributed"`` (default) - exact, and no task ever sorts a large group
      (``order_statistics``): histograms of each group narrow the range of values
      around the wanted ranks, and only the rows inside these ranges are sorted.
    * ``"buffer"`` - Spark's exact ``percentile`` aggregate: keeps a group's
      values in one aggregation buffer; fine when a group is bounded (e.g.
      one value per organisation and month).
    * ``"approx"`` - ``percentile_approx`` with bounded memory per group.
    """
    by = [by] if isinstance(by, str) else list(by)
    if method in ("buffer", "approx"):
        fn = (F.percentile_approx(value, list(probs), accuracy) if method == "approx"
              else F.percentile(value, list(probs)))
        q = df.groupBy(*by).agg(fn.alias("_q"))
        return q.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    if method != "distributed":
        raise ValueError(f"unknown method {method!r}")
    src = stable(df.select(*by, nan_to_null(F.col(value).cast("double")).alias("_v")))  # feeds several branches
    sizes = src.groupBy(*by).agg(F.count("_v").alias("_n"))
    places = sizes.where("_n > 0").select(*by, F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_i", "_p"), "_n")
    places = places.withColumn("_h", (F.col("_n") - 1) * F.col("_p") + 1)  # 1-based
    places = places.select(*by, "_i", "_h", F.explode(F.array(F.floor("_h"), F.ceil("_h"))).alias("_rank"))
    found = _matched(places, order_statistics(src, by, "_v", places.select(*by, "_rank").distinct(), "_rank"), [*by, "_rank"])
    low, high = (F.max(F.when(F.col("_rank") == f("_h"), F.col("_v"))) for f in (F.floor, F.ceil))
    ends = found.groupBy(*by, "_i", "_h").agg(low.alias("_lo"), high.alias("_hi"))
    got = ends.withColumn("_q", F.col("_lo") + (F.col("_h") - F.floor("_h")) * (F.col("_hi") - F.col("_lo")))
    out = got.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(n) for i, n in enumerate(names)])
    # groups whose values are all missing still get a row of NULLs
    return _matched(sizes.select(*by), out, by, "left").select(*by, *names)


SORTED_ROWS = 100_000  # of one range that a task may sort
CELLS = 1024  # of a histogram


def _matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, a missing group matching itself."""
    return join_left(left, right, list(keys), null_safe=True, how=how)


def _power(c: str) -> Column:
    """A number that ascends with the value's sign and power of two."""
    v = F.abs(F.col(c))
    power = F.when(v == 0, F.lit(0)).when(v == float("inf"), F.lit(3000)).otherwise(F.floor(F.log2(v)).cast("int") + 1200)
    return F.when(F.col(c) < 0, -power).otherwise(power)


def order_statistics(src: DataFrame, by: Sequence[str], value: str, ranks: DataFrame, rank: str,
                     most: int | None = None, cells: int = CELLS) -> DataFrame:
    """(by, rank, value): the values at some 1-based ranks of each group, exactly.

    A span is a range of a group's values that holds wanted ranks; at first it is the
    whole group.  While some span has more than ``most`` rows that differ, a histogram
    of its values, counted with partial aggregates, replaces it by the cells in which
    the ranks fall, whose least and greatest values are known.  The cells of a span are
    the values' powers of two, or, within one power, ``cells`` equal steps, so a few
    rounds suffice whatever the values' spread (at most 1 + 52 / log2(cells)).  Rows
    inside the last spans are sorted by span.  Spans of one value need no sort, however
    many rows they have.  ``src`` is read once a round and should be a written table;
    missing values are left out.
    """
    most = SORTED_ROWS if most is None else most
    rows = src.where(F.col(value).isNotNull()).select(*by, value)
    span = rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_size"))
    placed = _matched(ranks.select(*by, rank), span.withColumn("_before", F.lit(0).cast("bigint")), by)
    ids = [*by, "_lo", "_hi", "_before"]

    def inside(spans: DataFrame) -> DataFrame:
        found = _matched(rows, spans, by)
        return found.where(F.col(value).between(F.col("_lo"), F.col("_hi")))

    while True:
        placed = stable(placed)  # a row for each group and wanted rank
        wide = placed.where((F.col("_size") > most) & (F.col("_lo") < F.col("_hi")))
        if wide.isEmpty():
            break
        step = F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * cells).cast("int")
        cell = F.when(_power("_lo") == _power("_hi"), F.least(step, F.lit(cells - 1))).otherwise(_power(value))
        counts = (inside(wide.select(*ids).distinct()).groupBy(*ids, cell.alias("_cell"))
                  .agg(F.min(value).alias("_least"), F.max(value).alias("_most"), F.count(F.lit(1)).alias("_in")))
        upto = Window.partitionBy(*ids).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # at most ``cells`` rows
        counts = counts.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_in").over(upto), F.lit(0)))
        narrow = (_matched(wide, counts, ids)
                  .where((F.col(rank) > F.col("_start")) & (F.col(rank) <= F.col("_start") + F.col("_in")))
                  .select(*by, rank, F.col("_least").alias("_lo"), F.col("_most").alias("_hi"),
                          F.col("_in").alias("_size"), F.col("_start").alias("_before")))
        placed = placed.where(~((F.col("_size") > most) & (F.col("_lo") < F.col("_hi")))).select(*narrow.columns).unionByName(narrow)

    same = placed.where(F.col("_lo") == F.col("_hi")).select(*by, rank, F.col("_lo").alias(value))
    several = placed.where(F.col("_lo") < F.col("_hi"))
    order = Window.partitionBy(*ids).orderBy(value)  # at most ``most`` rows
    sorted_rows = (inside(several.select(*ids).distinct())
                   .withColumn(rank, F.col("_before") + F.row_number().over(order)))
    return same.unionByName(_matched(several.select(*ids, rank), sorted_rows.select(*ids, rank, value), [*ids, rank])
                            .select(*by, rank, value))

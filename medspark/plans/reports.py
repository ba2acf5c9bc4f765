"""Composite reports.  Each is DataFrame -> DataFrame.

Plan notes that hold for all reports
* Aggregate first, window second: every window below is partitioned by a
  group whose rows are categories of an already aggregated table (moieties,
  products, sources), so its partition size is bounded by the number of
  categories, not by the raw rows of a hot organisation or area.
* Ranking over all groups never uses an unpartitioned window on unbounded
  input; top-N keeps ``n`` distinct totals before ranking (``top_n_groups``).
* ``na_rm`` selects R's strict sum (N1, default, as in the source analyses)
  or the NA-skipping sum (N2).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medspark.functions.dose import (dose_factor, dose_units, micro_ddd, quantity_units, strength_per_single,
                                     volume_singles)
from medspark.functions.semantics import (agg_sum, exact_sum, explicit_missing, safe_div, sum_strict,
                                          window_sum)
from medspark.operators.calendar import trend_array
from medspark.operators.codelists import in_codelist
from medspark.operators.joins import join_left
from medspark.operators.organisations import apply_override
from medspark.operators.reshape import unpivot_longer
from medspark.operators.quality import percentiles_by
from medspark.operators.windows import share_of_group, stable, stacked_midpoint, top_n_groups


def _cols(cs: str | Sequence[str]) -> list[str]:
    return [cs] if isinstance(cs, str) else list(cs)


# --- enrichment ----------------------------------------------------------------

def with_areas(df: DataFrame, orgs: DataFrame, areas: DataFrame, org_key: str = "ods_code",
               area_key: str = "stp_code", area_overrides: Mapping | DataFrame | None = None) -> DataFrame:
    """Q5/Q7 enrichment: organisation -> area code (with overrides, X12) ->
    area and region names (J4).  Organisations missing from the register and
    areas missing from the map keep NULL names."""
    return df.join(org_areas(orgs, areas, org_key, area_key, area_overrides), org_key, "left")


def dose_volume_fact(activity: DataFrame, register: DataFrame, dictionary: DataFrame, ddds: DataFrame,
                     codes: DataFrame | Sequence | None = None, *, code: str = "vmp_snomed_code",
                     name: str = "vmp_product_name", quantity: str = "total_quantity",
                     org_key: str = "ods_code", area_overrides: Mapping | DataFrame | None = None,
                     ddd_by: Mapping[str, str] | str | None = None, ddd_col: str = "ddd") -> DataFrame:
    """Q5 (A1 F1 J4 X12 J5 J6 X11): activity in daily doses.

    Activity (optionally restricted to a codelist) gets the organisation's
    name and area code from the register (area overrides applied), the
    dictionary row by product code AND name (J5), and the DDD by product name
    (J6, ``{name: "nm"}``) or by moiety (``"vtmnm"``); ``ddd_col`` names the
    lookup's value column.  Adds
    ``volume_singles``, ``volume_mg_strength`` and ``volume_ddd`` (X11).
    The dictionary may fan out (one row per ingredient), as in the source.
    """
    act = activity if codes is None else in_codelist(activity, code, codes)
    reg = register.select(org_key, "ods_name", "stp_code")
    if area_overrides is not None:
        reg = apply_override(reg, org_key, "stp_code", area_overrides)
    named = act.join(reg, org_key, "left")
    enriched = join_left(named, dictionary, [code, name])
    by = ddd_by if ddd_by is not None else {name: "nm"}
    with_ddd = join_left(enriched, ddds, by)
    singles = volume_singles(quantity, "udfs")
    mg = singles * strength_per_single("udfs", "strnt_nmrtr_val", "strnt_dnmtr_val")
    return with_ddd.withColumns({"volume_singles": singles, "volume_mg_strength": mg,
                                 "volume_ddd": F.try_divide(mg, F.col(ddd_col))})


def org_areas(orgs: DataFrame, areas: DataFrame, org_key: str = "ods_code", area_key: str = "stp_code",
              area_overrides: Mapping | DataFrame | None = None) -> DataFrame:
    """Q7 lookup: organisation -> area code (overrides applied, X12), area and region names."""
    reg = orgs.select(org_key, area_key)
    if area_overrides is not None:
        reg = apply_override(reg, org_key, area_key, area_overrides)
    return reg.join(areas, area_key, "left")


def product_factors(dictionary: DataFrame, ddds: DataFrame, keys: Sequence[str], ddd_by: Mapping[str, str] | str,
                    moiety: str = "vtmnm", *, udfs: str = "udfs", numerator: str = "strnt_nmrtr_val",
                    denominator: str = "strnt_dnmtr_val", ddd_col: str = "ddd") -> DataFrame:
    """Q5 by product: ``keys``, moiety and ``factor``, the daily doses for one unit of
    quantity (fixed point, missing where the dictionary or the DDD is).  A dictionary
    with a row per ingredient gives a factor per ingredient."""
    joined = join_left(dictionary.select(*keys, moiety, udfs, numerator, denominator), ddds, ddd_by)
    return joined.select(*keys, moiety, dose_factor(udfs, numerator, denominator, ddd_col).alias("factor"))


def _fits_broadcast(df: DataFrame) -> bool:
    """Is the table, by the planner's estimate, below ``autoBroadcastJoinThreshold``?"""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def dose_volume(activity: DataFrame, factors: DataFrame, by: Sequence[str] | Mapping[str, Column], *,
                keys: Sequence[str] = ("vmp_code",), quantity: str = "quantity", moiety: str = "vtmnm",
                orgs: DataFrame | None = None, org_key: str = "ods_code", na_rm: bool = False,
                join_first: bool | None = None) -> DataFrame:
    """Q5 below the sums of Q6-Q12: volume per ``by`` and moiety, in whole micro-DDD
    (``volume_units``, DECIMAL(38,0)); strict sums (N1), or skipping ones (``na_rm``).

    ``activity`` holds raw or summed rows; ``orgs`` adds attributes by organisation
    that ``by`` may name.  Volumes are exact and linear in the quantity, so both plans
    give the same rows.  If the planner would broadcast the lookups, raw rows meet them
    in the scan's stage and only (``by``, moiety) rows are shuffled.  Otherwise the
    quantities are first summed by ``by``'s own columns, organisation and product, and
    the raw rows never join.
    """
    by = dict(by) if isinstance(by, Mapping) else {c: F.col(c) for c in by}
    lookups = [factors] if orgs is None else [factors, orgs]
    rows = activity.withColumn("_units", quantity_units(quantity))
    if not (all(map(_fits_broadcast, lookups)) if join_first is None else join_first):
        own = [c for c in activity.columns if c != quantity and (c in by or c in keys or orgs is not None and c == org_key)]
        total = exact_sum("_units", False) if not na_rm else F.when(F.count("_units") > 0, exact_sum("_units", True))
        rows = rows.groupBy(*own).agg(total.alias("_units"))
    rows = join_left(rows, factors, list(keys))
    if orgs is not None:
        rows = join_left(rows, orgs, org_key)
    volume = agg_sum(dose_units("_units", "factor"), na_rm)
    return (rows.groupBy(*[c.alias(n) for n, c in by.items()], moiety)
            .agg(micro_ddd(volume).alias("volume_units")))


def dictionary_view(dictionary: DataFrame, codes: DataFrame | Sequence, code: str, columns: Sequence[str]) -> DataFrame:
    """Q4 (F1 P1 A12): the distinct dictionary rows of the selected products."""
    return in_codelist(dictionary, code, codes).select(*columns).distinct()


def subtotals(df: DataFrame, groups: Sequence[str], value: str, out: str | None = None,
              level: str = "grp") -> DataFrame:
    """Sums per group with subtotals for every prefix of ``groups`` and the grand
    total; ``level`` is the grouping id of ``ROLLUP`` (0 = detail).

    The rows are summed once, at the finest level; every coarser level adds up the
    one below it, so raw rows are neither copied per level nor shuffled again."""
    groups, out = list(groups), out or value
    finer = df.groupBy(*groups).agg(F.sum(value).alias(out))
    types = {c: finer.schema[c].dataType for c in groups}
    levels = finer.withColumn(level, F.lit(0).cast("bigint"))
    for n in range(len(groups) - 1, -1, -1):
        finer = finer.groupBy(*groups[:n]).agg(F.sum(out).alias(out))
        missing = [F.lit(None).cast(types[c]).alias(c) for c in groups[n:]]
        levels = levels.unionByName(finer.select(
            *groups[:n], *missing, out, F.lit((1 << (len(groups) - n)) - 1).cast("bigint").alias(level)))
    return levels


# --- trends ----------------------------------------------------------------------

def national_trend(df: DataFrame, month: str = "year_month", moiety: str = "vtmnm",
                   value: str = "volume_ddd", na_rm: bool = False) -> DataFrame:
    """Q6 / A2: total per month and moiety."""
    return df.groupBy(month, moiety).agg(agg_sum(value, na_rm).alias(value))


def regional_trend(df: DataFrame, region: str = "comm_region_name", month: str = "year_month",
                   moiety: str = "vtmnm", value: str = "volume_ddd", na_rm: bool = False) -> DataFrame:
    """Q7 / A3 + X15: total per region, month and moiety; missing region explicit."""
    return (df.groupBy(explicit_missing(region).alias(region), month, moiety)
            .agg(agg_sum(value, na_rm).alias(value)))


def category_shares(df: DataFrame, group: str | Sequence[str], category: str, value: str = "volume_ddd",
                    na_rm: bool = False, share: str = "prop_use", pos: str = "pos",
                    total: str = "total", share_na_rm: bool | None = None) -> DataFrame:
    """Q8 / A4-A6 + W1-W3: per group and category the volume, its share of the
    group, the stacked midpoint (categories in name order) and the group total.

    ``na_rm`` is the rule of the inner sums, ``share_na_rm`` (the same unless
    given) that of shares and totals: the area report sums strictly inside and
    skips missing volumes outside.  The midpoint is a strict running sum (N3).
    """
    group = _cols(group)
    outer = na_rm if share_na_rm is None else share_na_rm
    sums = df.groupBy(*group, category).agg(agg_sum(value, na_rm).alias(value))
    w = Window.partitionBy(*group)
    out = sums.withColumn(total, window_sum(value, w, outer))
    out = out.withColumn(share, safe_div(F.col(value).cast("double"), F.col(total).cast("double")))
    return stacked_midpoint(out, value, group, category, pos).select(*group, category, value, share, pos, total)


def in_period(df: DataFrame, month: str, start: str, end: str) -> DataFrame:
    """closed month range; the literal dates fold to constants."""
    return df.where(F.col(month).between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def top_groups(shares: DataFrame, group: str | Sequence[str], n: int = 20, total: str = "total",
               rank: str = "rank", key_digits: int | None = None) -> DataFrame:
    """Q9/Q11 / W4 + F9 + O4: keep every row of the groups whose total is among
    the ``n`` largest (dense rank, ties kept).  Totals are ranked as they are;
    ``key_digits`` rounds them first, for sums of doubles with float noise."""
    group = _cols(group)
    shares = stable(shares)  # one execution of the upstream plan feeds both branches
    key = F.max(total) if key_digits is None else F.round(F.max(total), key_digits)
    groups = shares.groupBy(*group).agg(key.alias("_rank_key"))
    kept = top_n_groups(groups, "_rank_key", n, rank, materialise=False).drop("_rank_key")
    return join_left(shares, kept, group, null_safe=True, how="inner")


def moiety_share(df: DataFrame, entity: str | Sequence[str], moiety_col: str, moiety: str,
                 value: str = "volume_ddd", na_rm: bool = False, share: str = "prop_moiety") -> DataFrame:
    """Q12 / A7 + X18: per entity the total and the share of one moiety
    (conditional sum over the sum, zero-safe)."""
    entity = _cols(entity)
    part = F.when(F.col(moiety_col) == F.lit(moiety), F.col(value)).otherwise(F.lit(0).cast(df.schema[value].dataType))
    return (df.groupBy(*entity)
            .agg(agg_sum(value, na_rm).alias(value), agg_sum(part, na_rm).alias("_part"))
            .select(*entity, value, safe_div(F.col("_part").cast("double"), F.col(value).cast("double")).alias(share)))


# --- trend table -------------------------------------------------------------

def trend_table(df: DataFrame, keys: Sequence[str], month: str, value: str,
                lookups: Sequence[tuple[DataFrame, str]] = (), out: str = "trend") -> DataFrame:
    """Q3: one row per key with the gap-filled monthly array (R6 A18), its
    total (X19), whether more than 10 months are positive (X20), and names
    joined from lookups ``(table, key)`` (J4)."""
    monthly = df.groupBy(*keys, month).agg(F.sum(value).alias(value))
    arr = trend_array(monthly, keys, month, value, out, total="total_quantity", n_positive="_npos", lookups=lookups)
    return arr.withColumns({"_npos": F.col("_npos") > 10}).withColumnRenamed("_npos", "many_positive_months")


# --- two sources -------------------------------------------------------------

def area_names(ccg_map: DataFrame, area: str = "stp_code") -> DataFrame:
    """One row per area of the commissioner map: its name and region, which depend on
    the area alone (W5: the smallest non-missing one, N8)."""
    return (ccg_map.where(F.col(area).isNotNull()).groupBy(F.col(area).alias("stp"))
            .agg(F.min("comm_region_name").alias("comm_region_name"), F.min("stp_name").alias("stp_name"))
            .where(F.col("stp_name").isNotNull()))


def source_rows(hospital: DataFrame, org_area: DataFrame, community: DataFrame, ccg_map: DataFrame,
                *, hospital_month: str = "year_month", hospital_org: str = "ods_code",
                hospital_product: str = "product_name", hospital_value: str = "total_quantity",
                community_month: str = "month", community_ccg: str = "ccg_code",
                community_product: str = "product_name", community_value: str = "quantity") -> DataFrame:
    """Rows of both sources by area, before any sum: stp, month, source, product_name,
    quantity (U2 by column name); rows without an area are dropped (F5)."""
    h = (hospital.join(org_area.select(hospital_org, F.col("stp_code").alias("stp")), hospital_org, "left")
         .select("stp", F.col(hospital_month).alias("month"), F.lit("hospital").alias("source"),
                 F.col(hospital_product).alias("product_name"), F.col(hospital_value).alias("quantity")))
    ccgs = ccg_map.select(F.col("ccg_code").alias(community_ccg), F.col("stp_code").alias("stp"))
    c = (community.join(ccgs, community_ccg, "left")
         .select("stp", F.col(community_month).alias("month"), F.lit("community").alias("source"),
                 F.col(community_product).alias("product_name"), F.col(community_value).alias("quantity")))
    return c.unionByName(h).where(F.col("stp").isNotNull())


def combine_sources(hospital: DataFrame, org_area: DataFrame, community: DataFrame, ccg_map: DataFrame,
                    *, na_rm: bool = False, **columns: str) -> DataFrame:
    """Q13 (A22 U2 P8 F5 W5): hospital and community issues, at any grain, rolled up to
    area, month, source and product; rows of areas without a name are dropped.  Names
    come from the map, for areas that community issues occur in.

    One sum over both sources; names are joined to its rows, which are unique by
    their keys, so the union needs no distinct and the names no window.
    ``columns`` as for ``source_rows``.
    Output: comm_region_name, stp_name, stp, month, source, product_name, quantity.
    """
    sums = (source_rows(hospital, org_area, community, ccg_map, **columns)
            .groupBy("stp", "month", "source", "product_name").agg(agg_sum("quantity", na_rm).alias("quantity")))
    # asks for the quantity too, so that both uses of the sums share one shuffle
    seen = F.max(F.when(F.col("source") == "community", F.struct(F.lit(1), "quantity"))).alias("_seen")
    areas = sums.groupBy("stp").agg(seen).where(F.col("_seen").isNotNull()).select("stp")
    named = join_left(area_names(ccg_map), areas, "stp", how="left_semi")
    return (join_left(sums, named, "stp", how="inner")
            .select("comm_region_name", "stp_name", "stp", "month", "source", "product_name", "quantity"))


def source_share(combined: DataFrame, product: str | None = None) -> DataFrame:
    """Q14 (A2 W1 W2 F6): national quantity per month, source and product,
    the month-source total and the product's share of it; optionally one product."""
    nat = combined.groupBy("month", "source", "product_name").agg(sum_strict("quantity").alias("nat_quantity"))
    w = Window.partitionBy("month", "source")
    out = (nat.withColumn("nat_total_quantity", window_sum("nat_quantity", w, na_rm=False))
           .withColumn("prop_prescribing", safe_div(F.col("nat_quantity"), F.col("nat_total_quantity"))))
    if product is not None:
        out = out.where(F.col("product_name") == F.lit(product))
    return out


def area_share_by_source(rows: DataFrame, names: DataFrame, product: str,
                         sources: Sequence[str] = ("community", "hospital")) -> DataFrame:
    """Q16 (A5 W1 F6 W2 R2 R4): share of one product per area and source (denominator:
    the area's total over BOTH sources), wide by source, with the strict sum of the
    source shares (N15).

    ``rows`` as ``source_rows`` gives them for the period, ``names`` as ``area_names``.
    One conditional sum by area yields all numerators and the denominator, strict as
    the sums by product would be; areas without the product have no row."""
    def total(q):
        return F.when(F.count(q) == F.count(F.lit(1)), F.sum(q))

    def of(source):
        here = (F.col("source") == source) & (F.col("product_name") == product)
        n = F.count_if(here)
        return F.when((n > 0) & (n == F.count(F.when(here, F.col("quantity")))), F.sum(F.when(here, F.col("quantity"))))

    sums = (rows.groupBy("stp").agg(total(F.col("quantity")).alias("_all"), *[of(s).alias(f"_{s}") for s in sources],
                                    F.count_if(F.col("product_name") == product).alias("_n"))
            .where(F.col("_n") > 0))
    shares = join_left(sums, names, "stp", how="inner").select(
        "stp_name", "stp", F.lit(product).alias("product_name"),
        *[safe_div(F.col(f"_{s}"), F.col("_all")).alias(s) for s in sources])
    out = None
    for s in sources:
        out = F.col(s) if out is None else out + F.col(s)
    return shares.withColumn("total", out)


def trust_share_deciles(hospital: DataFrame, product: str, *, month: str = "year_month",
                        org: str = "ods_code", product_col: str = "product_name",
                        value: str = "total_quantity", method: str = "distributed") -> DataFrame:
    """Q15 (W1 W2 F6 A17 R3): each trust's share of one product in its monthly
    issues, then the 10th..90th percentiles of that share per month, long form
    ``(year_month, decile, prop_prescribing)``."""
    per = hospital.groupBy(month, org, product_col).agg(F.sum(value).alias(value))
    shared = share_of_group(per, value, [month, org], "prop_prescribing", na_rm=False)
    one = shared.where(F.col(product_col) == F.lit(product))
    names = [f"Percentile_{p}" for p in range(10, 100, 10)]
    wide = percentiles_by(one, month, "prop_prescribing", [p / 100 for p in range(10, 100, 10)], names,
                          method=method)
    return unpivot_longer(wide, [month], names, "decile", "prop_prescribing")

"""Codelists and ingredient lookups (SURVEY: F1-F3, F7, J2, J3, U1, U5, A10, A11, G1).

A codelist is a small set of product codes.  Literal codes typed by the user
become an ``isin`` (Catalyst turns it into an ``InSet`` and pushes it to the
parquet scan); a codelist held in a table becomes a left-semi join, which the
planner broadcasts when the table's bytes are few.  Apply it to the raw rows,
before they are aggregated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medspark.operators.joins import anti_join, semi_join
from medspark.sources.literals import literal_table

def in_codelist(df: DataFrame, col: str, codes: DataFrame | Sequence, code_col: str | None = None) -> DataFrame:
    """Keep rows whose code is in the codelist (NULL never matches)."""
    if isinstance(codes, DataFrame):
        code_col = code_col or col
        return semi_join(df, codes.select(code_col), {col: code_col})
    return df.where(F.col(col).isin(list(codes)))


def not_in_codelist(df: DataFrame, col: str, codes: DataFrame, code_col: str | None = None) -> DataFrame:
    """Keep rows whose code is absent; NA is a value here."""
    code_col = code_col or col
    return anti_join(df, codes.select(code_col), {col: code_col}, null_safe=True)


FEW_PATTERNS = 128  # so many are tested on each row; more go through the index of pieces
PIECE = 3  # characters


def contains_any(col: Column | str, patterns: Sequence[str]) -> Column:
    """case-sensitive ``col LIKE '%p%'`` OR-ed over the patterns, compiled."""
    c = F.col(col) if isinstance(col, str) else col
    tests = [c.contains(F.lit(p)) for p in dict.fromkeys(patterns)] or [F.lit(False)]
    while len(tests) > 1:  # a balanced tree
        tests = [a if b is None else a | b for a, b in zip(tests[::2], [*tests[1::2], None])]
    return tests[0]


def filter_contains_any(df: DataFrame, col: str, patterns: Sequence[str] | DataFrame) -> DataFrame:
    """F3 as a filter over the rows.

    One rule chooses the plan: up to ``FEW_PATTERNS`` listed patterns are tested on
    each row; more, or a table of patterns (its first column), are looked up with
    ``matching_values``, whose work grows with the values' length, not with
    rows x patterns."""
    if not isinstance(patterns, DataFrame):
        patterns = list(dict.fromkeys(patterns))
        if len(patterns) <= FEW_PATTERNS:
            return df.where(contains_any(col, patterns))
        patterns = literal_table(df.sparkSession, [(p,) for p in patterns], "pattern string")
    return semi_join(df, matching_values(df, col, patterns), col)


def _pieces(c: Column) -> Column:
    """The distinct pieces of a text, and the text itself where it is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(c) - PIECE + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, F.lit(PIECE))))


def _runs(c: Column, n: int) -> Column:
    """All runs of ``n`` characters of a text (and its end, shorter ones)."""
    runs = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.length(c) > 0, runs).otherwise(F.array().cast("array<string>"))


def matching_values(df: DataFrame, col: str, patterns: DataFrame) -> DataFrame:
    """F3 by an index: the distinct values of ``col`` that contain some pattern.

    Values and patterns are cut into pieces of three characters.  Every pattern is
    filed under the one of its pieces that the fewest values have; a pattern with a
    piece that none has can not match.  Values meet the patterns filed under their
    pieces by an equi-join and are tested.  Patterns shorter than a piece are filed
    under themselves and meet the values' shorter pieces."""
    values = df.select(F.col(col).alias("value")).where(F.col("value").isNotNull()).distinct()
    named = patterns.select(F.col(patterns.columns[0]).alias("pattern")).where(F.col("pattern").isNotNull()).distinct()
    long = named.where(F.length("pattern") >= PIECE)
    pieces = values.select("value", F.explode(_pieces(F.col("value"))).alias("piece"))
    held = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    parts = long.select("pattern", F.explode(_pieces(F.col("pattern"))).alias("piece"))
    filed = (parts.join(held, "piece", "left").groupBy("pattern")
             .agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"),
                  F.count_if(F.col("n").isNull()).alias("unknown"))
             .where("unknown = 0"))
    found = pieces.join(filed, "piece").where(F.col("value").contains(F.col("pattern"))).select("value")

    # patterns of no, one or two characters: values by their short pieces
    short = named.where(F.length("pattern") < PIECE)
    runs = [_runs(F.col("value"), n) for n in range(1, PIECE)]
    letters = values.select("value", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *runs))).alias("pattern"))
    return (found.union(semi_join(letters, short, "pattern").select("value"))
            .distinct().select(F.col("value").alias(col)))


def ingredient_lookup(products: DataFrame, links: DataFrame, ingredients: DataFrame, ddd: DataFrame,
                      names: Sequence[str], wildcards: bool = True, *,
                      product_id: str = "id", product_name: str = "nm", bnf_code: str = "bnf_code",
                      link_product: str = "vmp", link_ingredient: str = "ing",
                      ingredient_id: str = "id", ingredient_name: str = "nm",
                      ddd_product: str = "vpid", ddd_value: str = "ddd",
                      product_type: str = "vmp") -> DataFrame:
    """G1: products containing the named ingredients, with their DDD.

    product -INNER- link -INNER- ingredient (J2), -LEFT- ddd by product (J3);
    then exact (``IN``) or wildcard (``LIKE '%name%'`` OR-ed, F3) matching on
    the ingredient name.  As in the original helper, wildcard mode needs at
    least two names.  Output: type, id, bnf_code, nm, ingredient, ddd.
    """
    names = list(names)
    if wildcards and len(names) < 2:
        raise ValueError("wildcard matching takes at least two names")
    if not names:
        raise ValueError("no ingredient names given")
    ing = ingredients.select(F.col(ingredient_id).alias("_ing"), F.col(ingredient_name).alias("ingredient"))
    if wildcards:
        ing = filter_contains_any(ing, "ingredient", names)
    else:
        ing = ing.where(F.col("ingredient").isin(names))
    return _products_of(ing, products, links, ddd, product_id, product_name, bnf_code, link_product, link_ingredient,
                        ddd_product, ddd_value, product_type)


def _products_of(ing: DataFrame, products: DataFrame, links: DataFrame, ddd: DataFrame, product_id: str,
                 product_name: str, bnf_code: str, link_product: str, link_ingredient: str, ddd_product: str,
                 ddd_value: str, product_type: str) -> DataFrame:
    """J2/J3 from the ingredients outwards: the few wanted ingredients meet their links,
    these their products, these their DDD, so no join carries other ingredients' rows."""
    lk = links.select(F.col(link_product).alias("id"), F.col(link_ingredient).alias("_ing"))
    p = products.select(F.col(product_id).alias("id"), F.col(bnf_code).alias("bnf_code"), F.col(product_name).alias("nm"))
    d = ddd.select(F.col(ddd_product).alias("id"), F.col(ddd_value).alias("ddd"))
    matched = ing.join(lk, "_ing").join(p, "id").join(d, "id", "left")
    return matched.select(F.lit(product_type).alias("type"), "id", "bnf_code", "nm", "ingredient", "ddd")


def exact_or_wildcard_lookup(products: DataFrame, links: DataFrame, ingredients: DataFrame, ddd: DataFrame,
                             exact: Sequence[str], wildcard: Sequence[str], *,
                             product_id: str = "id", product_name: str = "nm", bnf_code: str = "bnf_code",
                             link_product: str = "vmp", link_ingredient: str = "ing",
                             ingredient_id: str = "id", ingredient_name: str = "nm",
                             ddd_product: str = "vpid", ddd_value: str = "ddd",
                             product_type: str = "vmp") -> DataFrame:
    """U1 in one pass: the distinct rows that the exact or the wildcard lookup finds.
    The ingredients are chosen once, so the joins run once."""
    ing = ingredients.select(F.col(ingredient_id).alias("_ing"), F.col(ingredient_name).alias("ingredient"))
    if len(set(wildcard)) <= FEW_PATTERNS:
        ing = ing.where(F.col("ingredient").isin(list(exact)) | contains_any("ingredient", wildcard))
    else:
        ing = filter_contains_any(ing, "ingredient", wildcard).union(ing.where(F.col("ingredient").isin(list(exact)))).distinct()
    return _products_of(ing, products, links, ddd, product_id, product_name, bnf_code, link_product, link_ingredient,
                        ddd_product, ddd_value, product_type).distinct()


def exact_union_wildcard(exact: DataFrame, wildcard: DataFrame) -> DataFrame:
    """``UNION DISTINCT`` of the exact and the wildcard matches."""
    return exact.unionByName(wildcard).distinct()


def missing_names(spark: SparkSession, requested: Sequence[str], found: DataFrame,
                  found_col: str = "ingredient", out: str = "ingredient") -> DataFrame:
    """Requested names that the lookup did not find (anti join on the name)."""
    req = literal_table(spark, [(n,) for n in dict.fromkeys(requested)], f"{out} string")
    return anti_join(req, found.select(F.col(found_col).alias(out)).distinct(), out, null_safe=False)


def availability_counts(df: DataFrame, by: str | Sequence[str], value: str,
                        flag: str = "ddd_available", out: str = "n") -> DataFrame:
    """A10: rows per group and per presence of ``value`` (``count(g, flag = !is.na(v))``)."""
    by = [by] if isinstance(by, str) else list(by)
    return (df.groupBy(*by, F.col(value).isNotNull().alias(flag))
            .agg(F.count(F.lit(1)).alias(out)))


def nonnull_counts(df: DataFrame, cols: Sequence[str], prefix: str = "n_") -> DataFrame:
    """One row with the number of non-missing values of each column."""
    return df.agg(*[F.count(F.col(c)).alias(f"{prefix}{c}") for c in cols])


def common_values(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """U4: the distinct values that both tables have; a missing value is one of them."""
    return a.select(col).intersect(b.select(col))

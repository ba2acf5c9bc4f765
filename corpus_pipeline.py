"""A training corpus from ``documents``: rules, near-duplicates, benchmark leaks,
secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medspark.llm import bpe, decontamination, near_dups, quality_rules, queries, secret_scan, storage

#: No stage but the first can be expressed in SQL alone: registers, embeddings,
#: entropies and merges are computed in code.  Tests hold the stages against
#: brute force.
ORACLE_SQL = None
#: Percent of the union of two documents' shingles that near-duplicates share.
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, on hosts that pass them."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group."""
    queries.importable(spark)
    return near_dups.keep_one(docs, percent=NEAR_PERCENT)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    queries.importable(spark)
    return decontamination.keep_clean(docs, queries.benchmark(spark, sf_dir))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and ``n_chars`` counted anew."""
    queries.importable(spark)
    return secret_scan.redact_secrets(docs).withColumn(
        "n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the text that they decode to."""
    queries.importable(spark)
    return bpe.encode(docs, queries.WORD_VOCABULARY)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("clean_of_benchmark", clean_of_benchmark),
    ("without_secrets", without_secrets),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = queries.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = storage.written(stage(spark, docs, sf_dir), name)
    return docs

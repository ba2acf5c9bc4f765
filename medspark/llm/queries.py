"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from medspark.llm import (bpe, decontamination, importance, language_model, lexical_search, license_scan, near_dups,
                          oracles, quality_rules, rank_bpe, repeats, secret_scan, sharding, storage, token_files)

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def importable(spark: SparkSession) -> None:
    """Python workers import this package: from where it lies, if it isn't installed."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(documents(spark, sf_dir))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(documents(spark, sf_dir), percent=85)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir), shards=8)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.new_path(spark, "tokens")
    token_files.write_token_files(documents(spark, sf_dir), BYTE_VOCABULARY, path)
    return token_files.token_digests(spark, path)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(documents(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), WORD_VOCABULARY)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir))


def op11_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_bpe.encode_decode(documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), benchmark(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_secrets, op2_near_duplicates, op3_decontamination, op4_shards, op5_quality, op6_token_files, op7_licenses, op8_language_model,
    op9_bpe, op10_repeats, op11_rank_bpe, op12_lexical_search,
    op13_importance)}
ORACLE_SQL = oracles.ORACLE_SQL

"""Shards of near-equal bytes by sampled splitters.

Records are ordered by a key: the hash of the text, then of the id, so equal
texts are neighbours.  A sample in which a record's chance grows with its size
gives splitters at equal steps of bytes; they cut the order into many ranges.
Exact sizes are counted for each range, and a range above twice the wanted size
(a much repeated text) is subdivided by the second part of the key, a part that is
still above it (many rows alike in text and id) by a number of the row itself.
Neighbouring ranges then form shards, cut where the running total of bytes passes
the next equal share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medspark.llm.storage import written

RANGES_PER_SHARD = 256
RANGE_BYTES = 128 << 20  # of texts: a range's rows, ids and sizes only, are numbered in one task
MAX_RANGES = 1 << 16  # bounds what the driver holds: splitters, and a size and count for each range
SAMPLES_PER_RANGE = 16
_UNIT = float(1 << 53)
_FRACTIONS = ("_tie", "_row")  # of equal keys, then of equal ids


def _fraction(*parts) -> Column:
    """A number in [0, 1) that depends on ``parts`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(_UNIT)


def splitters(keys: np.ndarray, weights: np.ndarray, n_ranges: int) -> np.ndarray:
    """Ascending distinct keys that cut the weight into ``n_ranges`` equal parts."""
    if not len(keys):
        return np.empty(0, np.int64)
    order = np.argsort(keys, kind="stable")
    running = np.cumsum(weights[order])
    steps = running[-1] * np.arange(1, n_ranges) / n_ranges
    return np.unique(keys[order][np.searchsorted(running, steps, "left").clip(0, len(keys) - 1)])


class Ranges:
    """Numbered ranges of records: ``cuts`` of the key, then levels of pieces, each
    dividing the ranges of the level above by a fraction that records have."""

    def __init__(self, cuts: np.ndarray):
        self.cuts, self.levels, self.n = cuts, [], len(cuts) + 1

    def divide(self, pieces: np.ndarray) -> None:
        self.levels.append((np.cumsum(pieces) - pieces, pieces))
        self.n = int(pieces.sum())

    def number(self) -> Column:
        cuts, levels = self.cuts, list(self.levels)

        @F.pandas_udf("int")
        def number(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for key, *fractions in columns:
                at = np.searchsorted(cuts, key.to_numpy(), "right")
                for (first, pieces), fraction in zip(levels, fractions, strict=False):
                    piece = np.minimum((fraction.to_numpy() * pieces[at]).astype(np.int64), pieces[at] - 1)
                    at = first[at] + piece
                yield pd.Series(at, dtype="int32")

        return number("_key", *_FRACTIONS)


def _looked_up(values: np.ndarray, kind: str):
    @F.pandas_udf(kind)
    def look(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in columns:
            yield pd.Series(values[part.to_numpy()])
    return look


def _sizes(rows: DataFrame, ranges: Ranges) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows of each range (at most a few for each of MAX_RANGES)."""
    found = (rows.groupBy(ranges.number().alias("part"))
             .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect())
    size, count = np.zeros(ranges.n, np.int64), np.zeros(ranges.n, np.int64)
    for row in found:
        size[row["part"]], count[row["part"]] = row["size"], row["n"]
    return size, count


def assign_shards(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
                  ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """One row per input row: id, size, text_crc32, law ``bytes``, shard, slot
    (gapless from 0 in each shard) and grown_shard (NULL: not the ``key`` law).

    Size is the text's UTF-8 bytes plus 1; a NULL text counts and hashes as an
    empty one.  NULL and repeated ids are ordinary, even if most rows are alike in
    id and text.  An empty table gives no rows.
    """
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.xxhash64(raw)
    rows = written(df.select(
        F.col(id_col), (F.octet_length(raw) + 1).cast("bigint").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"), key.alias("_key"),
        _fraction(F.lit("tie"), F.col(id_col)).alias("_tie"),
        _fraction(F.lit("row"), F.monotonically_increasing_id()).alias("_row"),
        _fraction(F.lit("sample"), F.col(id_col), key).alias("_draw")), "shard-keys")
    total = rows.agg(F.sum("size")).first()[0] or 0
    n_ranges = min(MAX_RANGES, max(shards * ranges_per_shard, math.ceil(total / RANGE_BYTES)))
    wanted = n_ranges * SAMPLES_PER_RANGE  # so many rows are drawn, at most, on average
    weight = F.col("size") * F.lit(wanted / max(total, 1))
    drawn = np.array([(r["_key"], r["w"]) for r in rows.where(F.col("_draw") < weight).select(
        "_key", F.greatest(weight, F.lit(1.0)).alias("w")).collect()], dtype=[("k", "i8"), ("w", "f8")])
    cuts = splitters(drawn["k"], drawn["w"], n_ranges)

    ranges, target = Ranges(cuts), max(total / n_ranges, 1)
    for _ in _FRACTIONS:
        size, count = _sizes(rows, ranges)
        if not (size > 2 * target).any():
            break
        ranges.divide(np.where(size > 2 * target, np.ceil(size / target), 1).astype(np.int64))
    else:
        size, count = _sizes(rows, ranges)
    middle = np.cumsum(size) - size / 2
    shard = np.minimum((middle * shards / max(total, 1)).astype(np.int64), shards - 1)
    before = np.cumsum(count) - count
    slot = before - before[np.searchsorted(shard, shard, "left")]

    in_part = Window.partitionBy("part").orderBy("_key", "_tie", F.col(id_col).asc_nulls_first(), "text_crc32")
    numbered = (rows.withColumn("part", ranges.number())
                .withColumn("at", F.row_number().over(in_part) - 1))
    return numbered.select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"),
        _looked_up(shard.astype(np.int32), "int")("part").alias("shard"),
        (_looked_up(slot, "bigint")("part") + F.col("at")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))

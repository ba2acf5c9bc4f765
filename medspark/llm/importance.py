"""Resampling of documents by their importance for a target's distribution.

A document's features, runs of words, fall into hashed buckets.  Two arrays of
bucket counts, of all documents and of the target, give one array of gains; a
document's weight is the mean gain of its features, read from that array.  Weights
with Gumbel noise that depends on the id alone are scores, and the highest scores
are a sample without replacement in proportion to the weights' exponentials.

Scores get exact ranks by parallel sorting by regular sampling.  The scored rows
are sorted within their partitions and written: the runs.  Every run gives rows at
regular steps; the sorted samples give, again at regular steps, the splitters.
Each run falls into segments between the splitters; the segments of one range are
exchanged and merged in one task, and the counts of the ranges before it, added
up, turn places into ranks.  Keys end with the row's place in its run, so all are
distinct, and a range holds at most a few times the mean however many scores tie.
Ranges beyond the last drawn rank are counted but not exchanged.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medspark.llm.storage import written
from medspark.llm.texts import map_texts

BUCKETS = 10_000
LONGEST = 1  # words of a feature
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
MAX_RUNS, MAX_RANGES = 1024, 4096
RANGE_ROWS = 256  # wanted in each range, until there are MAX_RANGES
LEAST_STEP = 16  # rows of a run to a sample
MAX_SAMPLES = 1 << 20  # rows of 40 bytes that the driver sorts, and one for each run
#: A-Z lowered; what can not stand in a word is a blank
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_KEY = np.dtype([("score", ">u8"), ("named", "u1"), ("id", ">u8"), ("n", ">u8"), ("run", ">u4"), ("at", ">u8")])


def buckets_of(text: bytes, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every feature: runs of 1 to ``longest`` words."""
    words = text.translate(_WORD).split()
    found = []
    for n in range(1, longest + 1):
        runs = words if n == 1 else [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
        found.append(np.fromiter(map(zlib.crc32, runs), np.uint32, len(runs)) % np.uint32(buckets))
    return len(words), np.concatenate(found).astype("<u4" if buckets > 1 << 16 else "<u2")


def features(df: DataFrame, id_col: str, text_col: str, longest: int, buckets: int) -> DataFrame:
    """(id, n_words, n_features, buckets): the buckets of a whole text, packed."""
    def make():
        def columns(texts):
            rows = [buckets_of(t, longest, buckets) for t in texts]
            return [pa.array([n for n, _ in rows], pa.int64()), pa.array([len(b) for _, b in rows], pa.int64()),
                    pa.array([b.tobytes() for _, b in rows], pa.binary())]
        return columns

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return map_texts(rows, make, "n_words bigint, n_features bigint, buckets binary", "id", "text")


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket.  Every task sends one row for each bucket at most;
    the driver gets one for each bucket."""
    packed = "<u4" if buckets > 1 << 16 else "<u2"

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for body in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(body, packed), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for row in (rows.select("buckets").mapInArrow(run, "bucket bigint, n bigint")
                .groupBy("bucket").agg(F.sum("n").alias("n")).collect()):
        counts[row["bucket"]] = row["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, in thousandths of a natural logarithm."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), float(len(source))
    ratio = (t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(doc_id: int | None, seed: str) -> int:
    """Thousandths of a Gumbel number that depends on the id alone (NULL: the empty id)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(rows: DataFrame, gain: np.ndarray, seed: str, min_words: int) -> DataFrame:
    """(id, n_features, weight, score, eligible) of each row of ``features``."""
    packed = "<u4" if len(gain) > 1 << 16 else "<u2"

    def run(batches):
        for batch in batches:
            ids, words, sizes = (batch.column(i) for i in range(3))
            weights = [int(gain[np.frombuffer(body, packed)].sum()) // max(n, 1)
                       for body, n in zip(batch.column(3).to_pylist(), sizes.to_pylist(), strict=True)]
            scores = [w + noise(i, seed) for w, i in zip(weights, ids.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [ids, sizes, pa.array(weights, pa.int64()), pa.array(scores, pa.int64()),
                 pa.array(words.to_numpy() >= min_words)], ["id", "n_features", "weight", "score", "eligible"])

    return rows.select("id", "n_words", "n_features", "buckets").mapInArrow(
        run, "id bigint, n_features bigint, weight bigint, score bigint, eligible boolean")


def sorted_runs(rows: DataFrame) -> DataFrame:
    """``rows``, sorted within at most ``MAX_RUNS`` partitions, with each row's run and
    place among the run's eligible rows, written."""
    names = [*rows.columns, "run", "at"]

    def run(batches):
        number, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            eligible = batch.column(4).to_numpy(zero_copy_only=False)
            at = before + np.cumsum(eligible) - 1
            before += int(eligible.sum())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, number), pa.int32()), pa.array(at, pa.int64())], names)

    order = [F.desc("eligible"), F.desc("score"), F.asc_nulls_first("id"), "n_features"]
    return written(rows.coalesce(MAX_RUNS).sortWithinPartitions(*order).mapInArrow(
        run, "id bigint, n_features bigint, weight bigint, score bigint, eligible boolean, run int, at bigint"), "runs")


def sort_keys(*columns: pd.Series) -> np.ndarray:
    """Byte strings in the order of the ranks: score descending, id ascending with
    NULL first, features, then the row's place, which makes them distinct."""
    score, named, doc_id, n, run, at = (c.to_numpy() for c in columns)
    flip = np.uint64(1 << 63)
    keys = np.empty(len(score), _KEY)
    keys["score"] = ~(score.astype(np.int64).view(np.uint64) ^ flip)
    keys["named"] = named
    keys["id"] = doc_id.astype(np.int64).view(np.uint64) ^ flip
    keys["n"], keys["run"], keys["at"] = n, run, at
    return keys.view(f"S{_KEY.itemsize}")


def _key_columns() -> list[Column]:
    """What ``sort_keys`` takes; an id that can be NULL would reach Python as a double."""
    return [F.col("score"), F.col("id").isNotNull().alias("named"), F.coalesce("id", F.lit(0)).alias("id"),
            F.col("n_features"), F.col("run"), F.col("at")]


def splitters(runs: DataFrame, n: int, n_ranges: int) -> np.ndarray:
    """Keys at regular steps among the samples that all runs give at regular steps.

    A range between two splitters holds at most the mean and a step's rows of each run."""
    n_runs = runs.agg(F.max("run")).first()[0] + 1
    step = max(LEAST_STEP, -(-n // min(MAX_SAMPLES, 4 * n_runs * n_ranges)))
    taken = runs.where(F.col("eligible") & (F.col("at") % step == step - 1)).select(*_key_columns()).toPandas()
    keys = np.sort(sort_keys(*(taken[c] for c in taken.columns)))
    return keys[np.arange(1, n_ranges) * len(keys) // n_ranges] if len(keys) else keys


def ranked(runs: DataFrame, draw_percent: int) -> DataFrame:
    """``runs`` with ``rank``: 1, 2, 3... of the drawn rows, else NULL."""
    n = runs.where("eligible").count()
    drawn = draw_percent * n // 100
    if not drawn:
        return runs.withColumn("rank", F.lit(None).cast("bigint"))
    n_ranges = min(MAX_RANGES, -(-n // RANGE_ROWS))
    cuts = splitters(runs, n, n_ranges)

    @F.pandas_udf("int")
    def range_of(score: pd.Series, named: pd.Series, doc_id: pd.Series, n: pd.Series, run: pd.Series,
                 at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, sort_keys(score, named, doc_id, n, run, at), "right"), dtype="int32")

    ranges = runs.where("eligible").withColumn("range", range_of(*_key_columns()))
    sizes = np.zeros(len(cuts) + 1, np.int64)
    for row in ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[row["range"]] = row["n"]
    before = np.cumsum(sizes) - sizes
    used = int(np.searchsorted(before, drawn, "left"))  # ranges that begin before the last drawn rank

    merged = Window.partitionBy("range").orderBy(F.desc("score"), F.asc_nulls_first("id"), "n_features", "run", "at")
    starts = F.array(*[F.lit(int(x)) for x in before[:used]])
    place = F.get(starts, F.col("range")).cast("bigint") + F.row_number().over(merged)
    inside = (ranges.where(F.col("range") < used).withColumn("rank", F.when(place <= drawn, place)).drop("range"))
    outside = runs.where(~F.col("eligible")).unionByName(ranges.where(F.col("range") >= used).drop("range"))
    return inside.unionByName(outside.withColumn("rank", F.lit(None).cast("bigint")))


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS,
             longest: int = LONGEST, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """One row per input row: id, n_features, weight, score, rank (NULL: not drawn).

    ``percent`` of the rows with at least ``min_words`` words are drawn, rounded
    down.  NULL and empty texts have no features and weight 0.  Equal scores rank
    by ascending id, NULL first; rows alike in both by their number of features and
    else in any order.  An empty table gives no rows; an empty target counts
    nothing.  Other columns aren't read."""
    rows = written(features(df, id_col, text_col, longest, buckets), "features")
    wanted = features(target.select(F.lit(0).alias("id"), F.col(target_text_col).alias("text")), "id", "text", longest,
                      buckets)
    gain = gains(bucket_counts(rows, buckets), bucket_counts(wanted, buckets))
    runs = sorted_runs(scored(rows, gain, seed, min_words))
    return ranked(runs, percent).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")

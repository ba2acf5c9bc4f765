"""Importance resampling against plain definitions, and its distributed sort."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from medspark.llm import importance, queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(params=["odd", "real", "empty"])
def docs(request):
    return request.getfixturevalue(request.param)


def crc_buckets(text, longest=1, buckets=10000):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(text))
    return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets
                    for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def expected(docs, target, longest=1, buckets=10000, percent=10, least=20):
    """Rows (id, n_features, weight, score, rank) as a multiset."""
    feats = [crc_buckets(t, longest, buckets) for _, t in docs]
    s, t = (Counter(b for f in x for b in f[1]) for x in (feats, [crc_buckets(x, longest, buckets) for x in target]))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]
    rows = []
    for (d, _), (words, f) in zip(docs, feats, strict=True):
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([words >= least, d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 2**32))), None])
    able = sorted((r for r in rows if r[0]), key=lambda r: (-r[4], r[1] is not None, r[1] or 0, r[2]))
    for rank, r in enumerate(able[:percent * len(able) // 100], 1):
        r[5] = rank
    return Counter(tuple(r[1:]) for r in rows)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def target(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def test_resampling(spark, docs):
    texts = [r["text"] for r in target(spark).collect()]
    assert rows_of(importance.resample(docs, target(spark))) == expected(pairs(docs), texts)


def test_longer_features_more_buckets_other_share(spark, odd):
    texts = [r["text"] for r in target(spark).collect()]
    got = importance.resample(odd, target(spark), percent=50, min_words=1, longest=3, buckets=70000)
    assert rows_of(got) == expected(pairs(odd), texts, 3, 70000, 50, 1)


def test_query(spark):
    got = queries.QUERIES["op13_importance"](spark, SF)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    want = expected(pairs(queries.documents(spark, SF)), [r["text"] for r in target(spark).collect()])
    assert rows_of(got) == want and any(r[4] == 1 for r in want)


def test_ties_repeated_rows_and_null_ids(spark):
    """One text for all: scores differ by ids alone; ids repeat, some are large or NULL."""
    text = " ".join(f"w{i}" for i in range(25))
    ids = [None, None, *range(200), *[7] * 60, *[2**60 + i for i in range(40)], -5, -2**62]
    rows = [(d, text if k % 4 else text + " more") for k, d in enumerate(ids)] + [(d, "few") for d in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = importance.resample(df, df.limit(0), percent=60)
    assert rows_of(got) == expected(rows, [], percent=60)


def test_empty_target_and_all_drawn(spark, odd):
    got = importance.resample(odd, odd.where("false"), percent=100, min_words=0)
    assert rows_of(got) == expected(pairs(odd), [], percent=100, least=0)


def test_ranges_of_regular_samples_are_even(spark, monkeypatch):
    """A third of all rows ties in score and id: they spread over ranges, ranks stay exact."""
    monkeypatch.setattr(importance, "RANGE_ROWS", 100)
    rng = random.Random(2)
    rows = [(5 if i % 3 == 0 else i, 2, 0, 0 if i % 3 == 0 else rng.randrange(-50, 50), True) for i in range(6000)]
    df = spark.createDataFrame(rows, "id bigint, n_features bigint, weight bigint, score bigint, eligible boolean")
    runs = importance.sorted_runs(df.repartition(6))
    cuts = importance.splitters(runs, 6000, 60)
    taken = runs.select(*importance._key_columns()).toPandas()
    keys = importance.sort_keys(*(taken[c] for c in taken.columns))
    assert len(set(keys.tolist())) == 6000
    assert np.bincount(np.searchsorted(cuts, keys, "right")).max() <= 150
    got = sorted((r["rank"], -r["score"], r["id"]) for r in importance.ranked(runs, 100).collect())
    assert [r[0] for r in got] == list(range(1, 6001)) and [r[1:] for r in got] == sorted((-r[3], r[0]) for r in rows)


def test_draws_follow_the_target(spark):
    """Texts in the target's words are drawn first."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("red", "green", "blue") if i % 10 == 0 else ("north", "south", "west")) + str(rng.randrange(9))
                         for _ in range(40))) for i in range(500)]
    like = spark.createDataFrame([(0, " ".join(t for i, t in rows[:200] if i % 10 == 0))], "item_id bigint, text string")
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    drawn = [r["doc_id"] for r in importance.resample(df, like).where("rank is not null").collect()]
    assert len(drawn) == 50 and sum(d % 10 == 0 for d in drawn) >= 25

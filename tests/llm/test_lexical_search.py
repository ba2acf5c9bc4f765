"""Ranked lexical search against plain scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from medspark.llm import lexical_search
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(params=["odd", "real", "empty"])
def docs(request):
    return request.getfixturevalue(request.param)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", brute.lower(text))


def best(docs, items, top=10):
    """Rows (item_id, rank, doc_id, score) as a multiset."""
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df, out = Counter(t for _, c in held for t in c), []
    for item_id, text in items:
        asked, scores = Counter(terms(text)), []
        for d, c in held:
            m = 25 + 75 * sum(c.values()) * n // total
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
                        for t, r in asked.items() if t in c)
            if score > 0:
                scores.append((-score, d is not None, d or 0, d))
        out += [(item_id, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:top], 1)]
    return Counter(out)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def pairs(df, key="doc_id"):
    return [(r[key], r["text"]) for r in df.select(key, "text").collect()]


def test_items_of_the_table(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = lexical_search.rank_documents(docs, items)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert rows_of(got) == best(pairs(docs), pairs(items, "item_id"))


def test_texts_as_items_in_small_shards_and_blocks(spark, odd, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD_BYTES", 400)
    monkeypatch.setattr(lexical_search, "ITEM_BLOCK_BYTES", 300)
    monkeypatch.setattr(lexical_search, "ROUND_BYTES", 4000)
    monkeypatch.setattr(lexical_search, "FIRST_READ", 1)
    monkeypatch.setattr(lexical_search, "LONG", 100)
    items = odd.selectExpr("doc_id AS item_id", "text")
    got = lexical_search.rank_documents(odd.repartition(3), items, top=4)
    assert rows_of(got) == best(pairs(odd), pairs(items, "item_id"), 4)


def test_ties_repeated_rows_null_and_large_ids(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD_BYTES", 200)
    rows = [(d, "same old text") for d in (None, None, 2**60 + 1, 2**60, 5, 5, *range(100, 130))]
    rows += [(d, f"same {d}") for d in range(40)] + [(99, None), (98, "  ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    asked = [(1, "old"), (1, "same same text"), (None, "TEXT"), (2, "unknown"), (3, None), (4, "38")]
    items = spark.createDataFrame(asked, "item_id bigint, text string")
    assert rows_of(lexical_search.rank_documents(df, items)) == best(rows, asked)


def test_no_items_no_documents(spark, odd):
    items = spark.createDataFrame([(1, "word1")], "item_id bigint, text string")
    assert lexical_search.rank_documents(odd, items.where("false")).count() == 0
    assert lexical_search.rank_documents(odd.where("false"), items).count() == 0
    assert lexical_search.rank_documents(odd.select("doc_id", odd["text"].substr(1, 0).alias("text")), items).count() == 0


def test_a_term_in_a_third_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD_BYTES", 20000)
    monkeypatch.setattr(lexical_search, "FIRST_READ", 4)
    rng = random.Random(5)
    rows = [(d, " ".join([*["hot"] * (d % 3 == 0) * rng.randint(1, 4), *(f"w{min(rng.randrange(400), rng.randrange(400))}"
                                                                        for _ in range(rng.randint(1, 80)))])) for d in range(3000)]
    asked = [(k, " ".join(["hot"] * rng.randint(0, 2) + [f"w{rng.randrange(400)}" for _ in range(rng.randint(1, 30))]))
             for k in range(40)]
    df, items = (spark.createDataFrame(x, f"{c} bigint, text string") for x, c in ((rows, "doc_id"), (asked, "item_id")))
    assert rows_of(lexical_search.rank_documents(df.repartition(5), items)) == best(rows, asked)


def test_reading_stops_before_the_lists_end():
    """One document far ahead: the tails of the lists aren't read."""
    class Counted:
        def __init__(self, values):
            self.values, self.furthest = values, 0

        def __len__(self):
            return len(self.values)

        def __getitem__(self, at):
            if isinstance(at, slice):
                self.furthest = max(self.furthest, min(at.stop, len(self.values)))
            return self.values[at]

    n = 100_000
    docs = Counted(np.arange(n, dtype=np.int32))
    impacts = np.concatenate(([10**6], np.arange(n - 1, 0, -1)))
    able, scores = lexical_search.nra([(docs, impacts, 3), (np.array([0], np.int32), np.array([7]), 2)], n, 1, 1)
    assert able.tolist() == [0] and scores.tolist() == [3 * 10**6 + 14] and docs.furthest < 1000
    able, scores = lexical_search.nra([(np.arange(n), np.full(n, 4), 1)], n, 3, 1)
    assert len(able) == n and (scores == 4).all()

"""The pipeline's near-duplicates against brute force at its own threshold."""

import random

import corpus_pipeline
from medspark.llm import near_dups, queries
from tests.llm import brute


def kept_at(rows, percent):
    """Ids that are the smallest of their component."""
    sets, up = {d: brute.shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d for d in ids if root(d) == d}


def test_stage_drops_copies_from_80_percent(spark):
    """Copies of texts of 30 to 400 words, some words apart: shares on both sides
    of 0.80 and 0.85, and a group that only links below 0.85 hold together."""
    rng, rows = random.Random(21), []
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(rng.choice([30, 100, 200, 400]))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(3):
            w = list(base)
            for at in rng.sample(range(len(w)), rng.randint(1, max(2, len(w) // 30))):
                w[at] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    far = [f"far{i}" for i in range(200)]
    apart = [w if i % 50 != 25 else f"x{i}" for i, w in enumerate(far)]  # four separate words: 176 of 216
    rows += [(len(rows), " ".join(far)), (len(rows) + 1, " ".join(apart))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    at_80, at_85 = kept_at(rows, 80), kept_at(rows, 85)
    assert len(rows) - 1 in at_85 - at_80 and len(at_85 - at_80) > 10
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert {r["doc_id"] for r in stage(spark, df, "").collect()} == at_80
    assert {r["doc_id"] for r in near_dups.keep_one(df, percent=85).collect()} == at_85


def test_stages_at_80_percent(spark):
    """The first three stages on the tables, the second at the pipeline's threshold."""
    sf, steps = "/root/testdata/sf0.001", dict(corpus_pipeline.STAGES)
    good = steps["quality"](spark, queries.documents(spark, sf), sf)
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    one = steps["near_duplicates"](spark, good, sf)
    ids = {r["doc_id"] for r in one.collect()}
    assert ids == kept_at(sorted(texts.items()), 80) < kept_at(sorted(texts.items()), 85)
    bench = [r["text"] for r in queries.benchmark(spark, sf).collect()]
    clean = {r["doc_id"] for r in steps["clean_of_benchmark"](spark, one, sf).collect()}
    assert clean == {d for d in ids if not any(b in texts[d] for b in bench)}
    assert corpus_pipeline.run(spark, sf).count() == len(clean)

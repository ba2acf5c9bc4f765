"""The pipeline's stages against plain definitions of their decisions."""

import corpus_pipeline
from medspark.llm import queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = queries.documents(spark, SF)
    columns, kept = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    bench = [r["text"] for r in queries.benchmark(spark, SF).collect()]
    steps = dict(corpus_pipeline.STAGES)

    good = steps["quality"](spark, docs, SF)
    assert good.columns == columns
    rows = {r["doc_id"]: r["text"] for r in good.collect()}
    assert set(rows) == {d for d, r in kept.items() if not brute.quality(r["text"])[-1]}

    one = steps["near_duplicates"](spark, good, SF)
    assert one.columns == columns
    rows = {r["doc_id"]: r["text"] for r in one.collect()}
    want = brute.near_duplicates([(d, kept[d]["text"]) for d in {r["doc_id"] for r in good.collect()}],
                                 corpus_pipeline.NEAR_PERCENT)
    assert set(rows) == {d for d, (_, _, stays) in want.items() if stays}

    clean = steps["clean_of_benchmark"](spark, one, SF)
    assert clean.columns == columns
    ids = {r["doc_id"] for r in clean.collect()}
    leaky = {d for d, t in rows.items() if any(b in t for b in bench)}
    assert leaky and not ids & leaky and ids == set(rows) - leaky

    safe = steps["without_secrets"](spark, clean, SF)
    assert safe.dtypes == docs.dtypes
    for r in safe.collect():
        assert brute.secrets(r["text"])[:3] == (0, 0, 0) and r["n_chars"] == len(r["text"])
        if "[SECRET]" not in r["text"]:
            assert r["text"] == kept[r["doc_id"]]["text"]

    tokens = steps["token_ids"](spark, safe, SF)
    assert {r["doc_id"] for r in tokens.collect()} == ids
    assert corpus_pipeline.run(spark, SF).count() == len(ids)


def test_stages_keep_odd_rows_and_extra_columns(spark, odd):
    """Every stage on hard texts and on columns named like internal ones."""
    docs, steps = odd, dict(corpus_pipeline.STAGES)
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for name in ("quality", "near_duplicates", "clean_of_benchmark", "without_secrets"):
        out = steps[name](spark, odd, SF)
        assert out.columns == odd.columns
        rows = out.collect()
        assert rows and all(r["a.b"] == 10 and r["_gone"] == 6 and r["_bad"] == 5 for r in rows)
        if name != "without_secrets":
            assert all(texts[r["doc_id"]] == r["text"] for r in rows)
        docs = steps[name](spark, docs, SF)
    assert steps["token_ids"](spark, docs, SF).count() == docs.count() > 0


def test_empty_documents(spark):
    docs = queries.documents(spark, SF).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0

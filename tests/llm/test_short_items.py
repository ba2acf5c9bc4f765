"""Benchmark items of one to four words."""

from medspark.llm import decontamination


def test_short_items_match_exactly(spark):
    docs = spark.createDataFrame([
        (1, "We know the Answer, is 42! and the answer is 42"), (2, "the answer is 43"), (3, "answer is"),
        (4, None), (5, ""), (6, "one two three four"), (None, "x paris")], "doc_id bigint, text string")
    items = spark.createDataFrame([
        (10, "The answer is 42"), (11, "paris"), (12, "one two three"), (13, "one two three"), (14, "--"), (15, None)],
        "item_id bigint, text string")
    got = sorted(decontamination.find_leaks(docs, items).collect(), key=str)
    assert sorted((tuple(r) for r in got), key=str) == sorted(
        [(1, 10, 2, 5, 0), (6, 12, 0, 2, 0), (6, 13, 0, 2, 0), (None, 11, 1, 1, 0)], key=str)
    kept = {r["doc_id"] for r in decontamination.keep_clean(docs, items).collect()}
    assert kept == {2, 3, 4, 5}
    kept = {r["doc_id"] for r in decontamination.keep_clean(docs, items, least_words=3).collect()}
    assert kept == {2, 3, 4, 5, None}
    assert decontamination.keep_clean(docs, items, least_words=5).count() == 7

"""Operators that compare documents, against plain definitions."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from medspark.llm import (decontamination, language_model, near_dups, repeats, sharding, storage, token_files)
from tests.llm import brute

BYTE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(params=["odd", "real", "empty"])
def docs(request):
    return request.getfixturevalue(request.param)


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def by_id(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.collect()}


def test_near_duplicates(docs):
    assert by_id(near_dups.near_duplicates(docs)) == brute.near_duplicates(pairs(docs))


def test_near_duplicates_of_a_large_varied_group(spark):
    """Variants of one text, unequally far apart: chains of links must hold."""
    rng = random.Random(11)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for d in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert by_id(near_dups.near_duplicates(df)) == brute.near_duplicates(rows)


def test_near_duplicate_nulls_and_repeated_rows(spark):
    text = " ".join(f"u{i}" for i in range(30))
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (7, text), (8, None)], "doc_id bigint, text string")
    got = Counter(tuple(r) for r in near_dups.near_duplicates(df).collect())
    assert got == {(None, 26, None, True): 1, (5, 26, 5, True): 2, (7, 26, 5, False): 1, (8, 0, 8, True): 1}


def test_registers_estimate_similarity():
    rng = np.random.Generator(np.random.PCG64(3))
    a = np.sort(rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2))
    b = np.sort(np.concatenate((a[::2], rng.integers(0, 1 << 63, 1500, dtype=np.uint64) * np.uint64(2) + np.uint64(1))))
    ra, rb = near_dups.registers(a), near_dups.registers(b)
    est = near_dups.estimates(ra[None], rb[None], np.array([3000.0]), np.array([3000.0]))[0]
    assert abs(est - 1 / 3) < 0.15
    one = near_dups.registers(np.array([1 << 56 | 0b1011 << 40], np.uint64))
    assert one[1] == (56 - 44 + 1) << 10 | 0b011 << 7 and np.count_nonzero(one) == 1


def test_repeats(docs):
    assert by_id(repeats.remove_repeats(docs)) == brute.repeats(pairs(docs))


def test_repeats_across_small_blocks(spark, monkeypatch):
    rng = random.Random(4)
    passages = [" ".join(f"p{k}x{i}" for i in range(rng.choice([19, 20, 21, 55]))) for k in range(12)]
    rows = []
    for d in range(120):
        parts = [rng.choice(passages) if rng.random() < .5 else " ".join(f"r{rng.randrange(10**6)}" for _ in range(
            rng.randint(0, 40))) for _ in range(rng.randint(0, 6))]
        rows.append((d * 7 % 121, " ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    monkeypatch.setattr("medspark.llm.blocks.BLOCK_BYTES", 3000)
    assert by_id(repeats.remove_repeats(df)) == brute.repeats(rows)


def test_repeats_of_null_and_repeated_ids(spark):
    long = " ".join(f"z{i}" for i in range(25))
    df = spark.createDataFrame([(None, long), (1, long + " x"), (2, long), (2, long)], "doc_id bigint, text string")
    got = Counter(tuple(r)[:3] for r in repeats.remove_repeats(df).collect())
    assert got == {(None, 25, 0): 1, (1, 26, 25): 1, (2, 25, 25): 2}


def test_repeats_of_many_copies_in_and_across_blocks(spark, monkeypatch):
    texts = [" ".join(f"c{k}x{i}" for i in range(30)) for k in range(3)]
    rows = [(d * 11 % 97, texts[0] if d % 3 else texts[d % 5 % 3]) for d in range(97)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr("medspark.llm.blocks.BLOCK_BYTES", 1500)
    assert by_id(repeats.remove_repeats(df)) == brute.repeats(rows)


def test_cover_has_all_differences():
    assert {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER} == set(range(repeats.PERIOD))


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(docs, order):
    rows = pairs(docs)
    got = by_id(language_model.score_texts(docs, order=order))
    for (d, _), want in zip(rows, brute.language_model(rows, language_model.MASS, order), strict=True):
        assert got[d][:4] == want[:4]
        assert math.isclose(got[d][4], want[4], rel_tol=1e-9) and math.isclose(got[d][5], want[5], rel_tol=1e-9)


def test_longer_histories_fit_training_texts_better(real):
    scores = [sum(r["score"] for r in language_model.score_texts(real, order=n).collect() if not r["held_out"]) for n in (1, 2, 3)]
    assert scores[0] < scores[1] < scores[2]


def test_language_model_beats_unigrams_on_held_out_texts(real):
    rows = [r for r in language_model.score_texts(real).collect() if r["held_out"]]
    assert rows and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_shards(docs):
    rows = pairs(docs)
    got = by_id(sharding.assign_shards(docs, 8))
    assert set(got) == {d for d, _ in rows}
    slots, sizes = defaultdict(list), Counter()
    for d, text in rows:
        size, crc, law, shard, slot, grown = got[d]
        raw = (text or "").encode()
        assert (size, crc, law, grown) == (len(raw) + 1, zlib.crc32(raw), "bytes", None) and 0 <= shard < 8
        slots[shard].append(slot)
        sizes[shard] += size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if rows:
        largest = max(s for s, *_ in got.values())
        mean = sum(sizes.values()) / 8
        assert all(abs(sizes[s] - mean) <= largest + 0.02 * mean for s in range(8))


def test_shards_of_a_hot_text_are_even(spark):
    rows = [(i, "same text " * 20 if i % 3 == 0 else f"text {i} " * 20) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sizes = Counter()
    for size, _, _, shard, *_ in by_id(sharding.assign_shards(df, 8)).values():
        sizes[shard] += size
    assert max(sizes.values()) <= 1.02 * min(sizes.values())


@pytest.mark.parametrize("ids", [[None], [7], [None, 7]])
def test_shards_of_rows_alike_in_id_and_text(spark, ids):
    """A third of all rows have one text and NULL or equal ids."""
    rows = [(ids[i % len(ids)], "same text " * 20) for i in range(6000)]
    rows += [(i, f"text {i:05d} " * 17) for i in range(12000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    sizes, slots = Counter(), defaultdict(list)
    for r in sharding.assign_shards(df, 8).collect():
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(sizes) == 8 and max(sizes.values()) <= 1.02 * min(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_token_files(spark, docs):
    tokenizer, path = Tokenizer.from_file(BYTE), storage.new_path(spark, "test-tokens")
    token_files.write_token_files(docs, BYTE, path)
    start, want = 0, {}
    for d, text in sorted(pairs(docs)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert by_id(token_files.token_digests(spark, path)) == want
    if want:
        one = token_files.read_tokens(spark, path).where(f"doc_id = {max(want)}").select("tokens").first()
        assert len(one["tokens"]) == want[max(want)][1]


def test_id_encoder_equals_the_library(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_ENTRIES", 50)
    rng, library = random.Random(6), Tokenizer.from_file(BYTE)
    parts = ["a", "don't", "'s", "''re", "12", "é", "×", "µ", "\n", "\n\n", " ", "  ", "\t", "<|endoftext|>", "--", "漢",
             "’", "A1b", "\u0300", "½", "\x00", "'S", "Ġ", "\u00a0"]
    texts = ["".join(rng.choice(parts) if rng.random() < .6 else " " for _ in range(rng.randint(0, 9)))
             for _ in range(5000)]
    encoder, got = token_files.IdEncoder(BYTE), []
    for first in range(0, len(texts), 83):
        ids, sizes = encoder.encode(pa.array(texts[first:first + 83]), 2)
        got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    want = [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert got == want


def test_id_encoder_of_blanks_and_signs(monkeypatch):
    """Blanks of all sorts before, between and after words, digits and signs."""
    monkeypatch.setattr(token_files, "CACHE_ENTRIES", 50)
    rng, library = random.Random(7), Tokenizer.from_file(BYTE)
    parts = [" ", "  ", "\n", "\r\n", "\t", "\x0b", "\x0c", "\x1c", "\x85", "\u2003", "\u3000", "\u200b", "ab", "Ω", "7",
             "²", "Ⅷ", ".", "--", "'", "'ll", "<|", "endoftext", "|>", "\x7f", "\U0001f642"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(5000)]
    encoder, got = token_files.IdEncoder(BYTE), []
    for first in range(0, len(texts), 83):
        ids, sizes = encoder.encode(pa.array(texts[first:first + 83]), 2)
        got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_id_encoder_asks_for_a_word_once_whatever_stands_beside_it():
    encoder, asked = token_files.IdEncoder(BYTE), []
    library = encoder._encode
    encoder._encode = lambda texts, **how: (asked.extend(texts), library(texts, **how))[1]
    encoder.encode(pa.array(["One two three four", "\tOne two"]), 2)
    assert "three" in "".join(asked)
    asked.clear()
    encoder.encode(pa.array(["One three, four. two; 5 two\nOne two!\n\n  three four\t\n"]), 2)
    assert asked and not any(c.isalpha() for c in "".join(asked))


def test_token_file_layout(spark, real):
    import pyarrow.parquet as pq
    from glob import glob

    path = storage.new_path(spark, "test-layout")
    token_files.write_token_files(real, BYTE, path)
    file = sorted(glob(path.removeprefix("file:") + "/*.parquet"))[0]
    meta = pq.ParquetFile(file).metadata.row_group(0)
    columns = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    tokens = next(c for n, c in columns.items() if n.startswith("tokens"))
    assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(tokens.encodings) and tokens.has_column_index
    assert columns["doc_id"].has_offset_index


def test_token_files_with_nulls_and_repeated_rows(spark):
    path = storage.new_path(spark, "test-nulls")
    df = spark.createDataFrame([(2, "b"), (None, "a"), (2, "b"), (1, None)], "doc_id bigint, text string")
    token_files.write_token_files(df, BYTE, path)
    got = sorted(tuple(r)[:3] for r in token_files.token_digests(spark, path).na.fill(-1, ["doc_id"]).collect())
    assert got == [(-1, 0, 2), (1, 2, 1), (2, 3, 2), (2, 5, 2)]


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_leaks_are_found_and_only_they(spark):
    rng = random.Random(9)
    stock = [f"v{i}" for i in range(300)]
    texts = {k: [rng.choice(stock) for _ in range(rng.randint(8, 50))] for k in range(30)}
    rows, want = [], set()
    for d in range(300):
        host = [rng.choice(stock) for _ in range(rng.randint(0, 150))]
        if d % 3 == 0:
            k = rng.randrange(30)
            w = list(texts[k])
            for _ in range(rng.randint(0, len(w) // 10)):
                at = rng.randrange(len(w))
                w[at:at + rng.randint(0, 1)] = rng.choice([[], ["odd"]])
            host[rng.randint(0, len(host)):0] = w
            want.add((d, k))
        rows.append((d, " ".join(host)))
    df = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id bigint, text string")
    bench = items(spark, [(k, " ".join(w).upper()) for k, w in texts.items()] + [(99, None), (98, ""), (97, "v1 v2")])
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontamination.find_leaks(df, bench).collect()}
    def edits(d, k):
        text = rows[d][1].split()
        found = [e for s in range(len(text)) if (e := decontamination.edits_at(texts[k], text, s, len(texts[k]) // 5))]
        return min(found)[0] if found else None
    exact = {(d, k): e for d in range(0, 300, 3) for k in texts if (e := edits(d, k)) is not None}
    assert len(want - set(got)) <= 0.02 * len(want)
    assert all(exact.get(p) == e for p, e in got.items() if p[0] % 3 == 0)
    assert all(p[0] % 3 == 0 or edits(*p) is not None for p in got)
    kept = {r["doc_id"] for r in decontamination.keep_clean(df, bench).collect()}
    assert kept == {r[0] for r in rows} - {d for d, _ in got} | {900, 901}
    assert decontamination.find_leaks(df.where("false"), bench).count() == 0
    assert decontamination.find_leaks(df, bench.where("false")).count() == 0


def test_leaks_in_the_tables(spark, real):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(real, bench).collect()}
    texts = pairs(real)
    assert {(d, r["item_id"]) for r in bench.collect() for d, t in texts if r["text"] in t} <= got


def test_embedding_keeps_close_texts_close():
    rng = random.Random(1)
    words = [f"e{i}".encode() for i in range(500)]
    item = [rng.choice(words) for _ in range(30)]
    index = decontamination.Index([(1, b" ".join(item))])

    def walk(w):
        ids = decontamination.word_ids(w)
        at = index._walk(ids, np.zeros(1, np.int64), 60)[:, 0, :]
        return np.append(ids, decontamination._PAD)[at]

    near, far = item[:10] + item[11:], [rng.choice(words) for _ in range(30)]
    assert (walk(item) == walk(near)).mean() > 3 * (walk(item) == walk(far)).mean()

"""Operators that judge each document by itself, against plain definitions."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from medspark.llm import bpe, license_scan, quality_rules, secret_scan
from tests.llm import brute

WORD = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(params=["odd", "real", "empty"])
def docs(request):
    return request.getfixturevalue(request.param)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def test_secrets(docs):
    got = by_id(secret_scan.scan_secrets(docs))
    want = {d: brute.secrets(t) for d, t in texts(docs).items()}
    assert {d: tuple(r)[1:5] for d, r in got.items()} == want
    for d, text in texts(docs).items():
        for span in filter(None, got[d]["spans"].split(",")):
            kind, a, b = span.split(":")
            assert kind in secret_scan.KINDS and 0 <= int(a) < int(b) <= len(text)


def test_entropy_is_counted_incrementally():
    from math import log2

    text, width = b"aabbccddeeffgghh0123456789abcdefZYXWVU", 16
    want = []
    for i in range(len(text) - width + 1):
        w = text[i:i + width]
        h = -sum(w.count(c) / width * log2(w.count(c) / width) for c in set(w))
        if h >= 3.5 - 1e-9:
            want.append(i)
    spans = secret_scan.entropy_windows(text, width, 3.5)
    covered = {i for a, b in spans for i in range(a, b - width + 1)}
    assert covered >= set(want) and {i for w in want for i in range(w, w + width)} == {
        i for a, b in spans for i in range(a, b)}


def test_allowed_strings_are_suppressed():
    allowed = secret_scan.AllowList.of()
    for text in (b"id 123E4567-E89B-12D3-A456-426614174000 end", b"abcdefghij0123456789ABCDEFGHIJKLMN",
                 b"some-long-hyphenated-file-name-of-words", b"2024-01-01-2024-12-31-000000"):
        assert not [s for s in secret_scan.find_secrets(text, allowed) if s[2].startswith("entropy")]
    assert [s[2] for s in secret_scan.find_secrets(b"x 9fJ2kLq8ZrT4vWm1XyB6nCd3 y", allowed)] == ["entropy_base64"]


def test_redaction_keeps_all_else(odd):
    got = texts(secret_scan.redact_secrets(odd))
    want = texts(odd)
    assert got[54] == 'password = "[SECRET]" and [SECRET] hex [SECRET] é token:short'
    assert {d: t for d, t in got.items() if d != 54} == {d: t for d, t in want.items() if d != 54}


def test_licenses(docs):
    got = by_id(license_scan.scan_licenses(docs))
    want = {d: brute.licenses(t) for d, t in texts(docs).items()}
    assert {d: tuple(r)[1:6] for d, r in got.items()} == want
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
               for r in got.values())


def test_license_spans_survive_edits(spark):
    label, text = license_scan.TEMPLATES[0]
    w = text.split()
    w[10:11] = ["altered", "words"]
    df = spark.createDataFrame([(1, "intro here " + " ".join(w) + " outro"), (2, "free of charge to any")],
                               "doc_id bigint, text string")
    got = by_id(license_scan.scan_licenses(df))
    assert got[1]["labels"] == "mit" and got[1]["score"] > 0.9
    assert got[1]["template_spans"] == f"mit:2:{len(license_scan.words(' '.join(w).encode())) + 1}"
    assert got[2]["labels"] == "" and 0 < got[2]["score"] < 0.6


def test_matching_statistics_of_the_automaton():
    sequences = [b"a b a b c".split(), b"b a b b a".split(), b"c a".split()]
    automaton = license_scan.SuffixAutomaton(sequences)
    runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for run in runs:
        state = automaton.find(list(run))
        assert {n for n, s in enumerate(sequences)
                if any(tuple(s[i:i + len(run)]) == run for i in range(len(s)))} == set(automaton.ends[state])
        for n, end in automaton.ends[state].items():
            assert tuple(sequences[n][end - len(run):end]) == run


def test_bpe_equals_the_library(docs):
    tokenizer = Tokenizer.from_file(WORD)
    got = by_id(bpe.encode_decode(docs, WORD))
    for d, text in texts(docs).items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert tuple(got[d])[1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                                     hashlib.sha256(decoded.encode()).hexdigest())


def test_bpe_automaton_on_random_words():
    import random

    rng, encoder, tokenizer = random.Random(2), bpe.encoder(WORD), Tokenizer.from_file(WORD)
    for _ in range(2000):
        word = "".join(rng.choice("aeinthors") for _ in range(rng.randint(1, 24)))
        assert encoder.automaton.encode(word) == tokenizer.encode(word, add_special_tokens=False).ids


def test_bpe_handles_each_run_of_a_slice_once():
    import pyarrow as pa

    tokenizer, encoder = Tokenizer.from_file(WORD), bpe.WordEncoder(WORD)
    texts = [" \tWord word. \x0b\x0c", "", "ÀÉ, word.\nword. ÀÉ, x\x85y\x1fz " * 50, "\u200b", "word. it's <|endoftext|>a"]
    offsets, numbers, entries = encoder.chunks(pa.array(texts))
    assert len(entries) == len(set(" ".join(texts).encode().split()) | {b""})
    got = [[int(x) for n in numbers.to_pylist()[a:b] for x in entries[n][1].split()]
           for a, b in zip(offsets.tolist(), offsets.tolist()[1:], strict=False)]
    assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_quality_measures(docs):
    got = by_id(quality_rules.judge(docs))
    want = {d: brute.quality(t) for d, t in texts(docs).items()}
    assert {d: tuple(r)[1:7] for d, r in got.items()} == want
    assert not any(r["kept"] for r in got.values() if r["base_failed"])


def test_bad_hosts_take_their_documents_along(spark):
    good, junk = " ".join(f"word{i}" for i in range(40)), "# $ % & | " * 20
    rows = [(i, good, f"h{i % 20}") for i in range(400)] + [(1000 + i, junk + f"x{i}", "bad") for i in range(60)]
    rows += [(2000, good, "bad"), (2001, junk, "h1"), (2002, good, None), (2003, "few words", "small"), (2004, good, "small")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = by_id(quality_rules.judge(df))
    assert not got[2000]["kept"] and got[2000]["host_failed"]
    assert got[2002]["kept"] and got[0]["kept"]
    kept = {r["doc_id"] for r in quality_rules.keep_good(df).collect()}
    assert kept == {d for d, r in got.items() if r["kept"]}


def test_allowed_words_free_only_their_part():
    allowed, key = secret_scan.AllowList.of(), b"9fJ2kLq8ZrT4vWm1XyB6nCd3pQs5tUh7"
    for text in (b"hooks/example/T0/B0/" + key, b"example_" + key, key + b"/placeholder", b"a/example/" + key + b"/example-b"):
        spans = [s for s in secret_scan.find_secrets(text, allowed) if s[2] == "entropy_base64"]
        assert any(text[a:b].find(key[4:-4]) >= 0 for a, b, *_ in spans), text
        assert b"example" not in b"|".join(text[a:b] for a, b, *_ in spans)
    assert not secret_scan.find_secrets(b"/".join([b"abcdefghij" + key[:12]] * 3), allowed)


def test_offsets_of_a_long_text_take_linear_time():
    """Many spans behind non-ASCII characters: four times the text, not sixteen times the work."""
    import time

    allowed, took = secret_scan.AllowList.of(), []
    for n in (5000, 20000):
        text = "\n".join(f"é token = abcDEF{i:08d}" for i in range(n)).encode()
        spans = secret_scan.find_secrets(text, allowed)
        began = time.perf_counter()
        found = secret_scan.in_code_points(text, spans)
        took.append(time.perf_counter() - began)
        assert len(found) >= n and [s[:3] for s in found[:2]] == [
            (len(text[:a].decode()), len(text[:b].decode()), k) for a, b, k, *_ in spans[:2]]
        last = spans[-1]
        assert found[-1] == (len(text[:last[0]].decode()), len(text[:last[1]].decode()), last[2])
    assert took[1] < 10 * took[0] + 0.05


@pytest.mark.parametrize("chunk", ["<|endoftext|>" * 100_000, "a<|startoftext|><|endoftext|>B" * 20_000, "x" * 50_000])
def test_special_strings_in_one_chunk(chunk):
    want = Tokenizer.from_file(WORD).encode(chunk, add_special_tokens=False).ids
    assert list(bpe.WordEncoder(WORD).ids_of(chunk)) == want

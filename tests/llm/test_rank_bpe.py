"""Byte-level BPE by ranks, against the library on whole texts."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from medspark.llm import queries, rank_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(params=["odd", "real", "empty"])
def docs(request):
    return request.getfixturevalue(request.param)


def digests(text, library):
    ids = library.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode_bytes(ids)).hexdigest())


def test_digests_equal_the_library(docs, library):
    want = {r["doc_id"]: digests(r["text"], library) for r in docs.collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in rank_bpe.encode_decode(docs, PATH, PATTERN).collect()}
    assert got == want


def test_lists_and_raw_bytes(odd, library):
    ids = rank_bpe.encode(odd, PATH, PATTERN)
    raw = {r["doc_id"]: bytes(r["raw"]) for r in rank_bpe.decode(ids, PATH, PATTERN).collect()}
    assert raw == {r["doc_id"]: (r["text"] or "").encode() for r in odd.collect()}
    assert {r["doc_id"]: r["ids"] for r in ids.collect()} == {
        r["doc_id"]: library.encode_ordinary(r["text"] or "") for r in odd.collect()}


def test_ids_that_split_a_character(spark):
    df = spark.createDataFrame([(1, [0, None]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    got = {r["doc_id"]: r["raw"] for r in rank_bpe.decode(df, PATH, PATTERN).collect()}
    assert got[2] is None and got[3] == b"" and len(got[1]) == 1


def test_cuts_are_safe(library, monkeypatch):
    """Texts of odd parts, cut wherever the pieces allow."""
    monkeypatch.setattr(rank_bpe, "LONG", 3)
    rng, ranks = random.Random(8), rank_bpe.RankEncoder(PATH, PATTERN)
    parts = ["a", "Zz", "'s", "'", "''re", "'ll", "12", "é", "×", "½", "\n", "\n\n", " ", "  ", "\t", "\x1c", "\x85",
             "\xa0", "　", "漢字", "。", "、", "カナ", "한글", "!", "--", "<|endoftext|>", "̀", "\U0001f642", "٣", "x9"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        want = library.encode_ordinary(text)
        assert ranks.encode(text) == want, text
        assert b" ".join([e[1] for e in ranks.entries(text)]) == " ".join(map(str, want)).encode(), text


@pytest.mark.parametrize("text", ["a" * 300_000, " " * 300_000, " " * 300_000 + "x", "\n" * 300_000 + " y", "ab1." * 50_000,
                                  "漢字。" * 50_000, "'s" * 100_000])
def test_long_runs(text, library):
    assert rank_bpe.RankEncoder(PATH, PATTERN).encode(text) == library.encode_ordinary(text)


def test_white_space_that_overflows_the_matcher():
    """Two million blanks: the library itself fails on them."""
    ranks = rank_bpe.RankEncoder(PATH, PATTERN)
    for text in (" " * 2_000_000, "a" + "\n" * 2_000_000 + " b", "\t" * 2_000_000 + "b"):
        ids = ranks.encode(text)
        assert ranks.decode(ids) == text.encode()
    assert ranks.encode(" " * 2_000_001 + "b") == ranks.encode(" " * 2_000_000) + ranks.encode(" b")


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    want = {r["doc_id"]: digests(r["text"], library) for r in queries.documents(spark, sf).collect()}
    rows = queries.QUERIES["op11_rank_bpe"](spark, sf).collect()
    assert {r["doc_id"]: tuple(r)[1:4] for r in rows} == want and len(rows) == len(want)

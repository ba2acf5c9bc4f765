"""Repeated passages found by difference-cover anchors.

Every window of ``WINDOW`` words that also starts earlier (in a smaller id, or
earlier in the same document) loses its words.  Hashing all windows would ship
one key for each word of the corpus.  Instead short anchors are hashed only at
positions whose remainder modulo ``PERIOD`` is in a difference cover: for any two
starts some offset below ``PERIOD`` puts both on the cover, so equal windows share
an anchor at the same offset.  Anchors found once rule out all windows around
them; where anchors recur the match is extended: the windows that hold them are
compared whole, by 96-bit hashes, and the earliest of each kind is kept.

Documents whose words all equal an earlier document's are settled by one key, which
a block sends once for all its copies.
Both exchanges are block requests (``medspark.llm.blocks``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from medspark.llm import blocks as B
from medspark.llm.texts import hashed_texts, joined

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)  # every difference modulo 13 occurs once
ANCHOR = WINDOW - PERIOD + 1
_ON_COVER = np.isin(np.arange(PERIOD), COVER)
_FIRST = -(1 << 63)  # stands for a NULL id: before all others
ANCHORS, COPIES, WINDOWS = 0, 1, 2
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


class Block:
    """Texts of a block with their order, words' hashes and anchors."""

    def __init__(self, body: bytes):
        self.ids, self.texts = B.block_rows(body)
        self.hashes = list(hashed_texts(self.texts, lower=False))
        self.long = [i for i, h in enumerate(self.hashes) if len(h) >= WINDOW]
        self.order = np.array([(_FIRST if d is None else d) for d in self.ids], np.int64)
        self.tie = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in self.texts), np.uint64, len(self.texts))
        self.places, keys = [], []
        for i in self.long:
            n = len(self.hashes[i]) - ANCHOR + 1
            at = np.flatnonzero(_ON_COVER[np.arange(n) % PERIOD])
            self.places.append(at)
            keys.append(joined(self.hashes[i], ANCHOR)[at])
        self.anchors, self.anchor_of, times = np.unique(
            np.concatenate(keys) if keys else np.empty(0, np.uint64), return_inverse=True, return_counts=True)
        self.twice = times > 1

    def sequences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """128-bit keys of the long documents' distinct word sequences (two columns),
        the row of the earliest document of each, and each long document's sequence."""
        digests = [xxhash.xxh3_128_intdigest(b" ".join(self.texts[i].split())) for i in self.long]
        high = np.array([d >> 64 for d in digests], np.uint64)
        low = np.array([d & (2**64 - 1) for d in digests], np.uint64)
        rows = np.array(self.long, np.int64)
        by = np.lexsort((self.tie[rows], self.order[rows], low, high))
        new = np.ones(len(by), bool)
        new[1:] = (high[by][1:] != high[by][:-1]) | (low[by][1:] != low[by][:-1])
        group = np.empty(len(by), np.int64)
        group[by] = np.cumsum(new) - 1
        return high[by[new]], low[by[new]], rows[by[new]], group

    def copies(self, replies: dict, buckets: int) -> set[int]:
        """The rows whose word sequence an earlier document has, here or elsewhere."""
        high, _, earliest, group = self.sequences()
        elsewhere = np.zeros(len(high), bool)
        for bucket, at in B.dealt(high, buckets):
            elsewhere[at] = replies[COPIES, bucket]["yes"]
        rows, head = np.array(self.long, np.int64), earliest[group]
        here = (self.order[rows] != self.order[head]) | (self.tie[rows] != self.tie[head])
        return set(rows[here | elsewhere[group]].tolist())

    def ask_anchors(self, buckets: int):
        for bucket, at in B.dealt(self.anchors, buckets):
            yield bucket, ANCHORS, {"key": self.anchors[at]}
        high, low, earliest, _ = self.sequences()
        for bucket, at in B.dealt(high, buckets):
            yield bucket, COPIES, {"key": high[at], "low": low[at], "order": self.order[earliest[at]],
                                   "tie": self.tie[earliest[at]]}

    def candidates(self, replies: dict, buckets: int) -> "Candidates":
        """The windows that hold a recurring anchor, of documents that are no copies."""
        recurring = self.twice.copy()
        for bucket, at in B.dealt(self.anchors, buckets):
            recurring[at] |= replies[ANCHORS, bucket]["yes"]
        copies = self.copies(replies, buckets)
        docs, starts, keys, checks, first = [], [], [], [], 0
        for i, at in zip(self.long, self.places, strict=True):
            found = recurring[self.anchor_of[first:first + len(at)]]
            first += len(at)
            if i in copies or not found.any():
                continue
            hashes = self.hashes[i]
            n = len(hashes) - WINDOW + 1
            running = np.zeros(len(hashes) + 1, np.int32)
            running[at[found] + 1] = 1
            np.cumsum(running, out=running)
            here = np.flatnonzero(running[PERIOD:PERIOD + n] > running[:n])
            docs.append(np.full(len(here), i, np.int64))
            starts.append(here)
            keys.append(joined(hashes, WINDOW)[here])
            checks.append(joined(hashes ^ np.uint64(0x5851F42D4C957F2D), WINDOW)[here])
        return Candidates(self, copies, docs, starts, keys, checks)


class Candidates:
    """Windows to compare; of equal ones in the block the earliest asks."""

    def __init__(self, block: Block, copies: set[int], docs, starts, keys, checks):
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        self.copies = copies
        self.doc, self.start = cat(docs, np.int64), cat(starts, np.int64)
        key, check = cat(keys, np.uint64), (cat(checks, np.uint64) >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((self.start, block.tie[self.doc], block.order[self.doc], check, key))
        key, check = key[order], check[order]
        doc, start = self.doc[order], self.start[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
        self.group = np.empty(len(key), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.key, self.check, self.first_doc, self.first_start = key[new], check[new], doc[new], start[new]

    def ask(self, block: Block, buckets: int):
        for bucket, at in B.dealt(self.key, buckets):
            doc = self.first_doc[at]
            at, doc = at[by := np.lexsort((self.first_start[at], doc))], doc[by]
            yield bucket, WINDOWS, {"key": self.key[at], "check": self.check[at], "order": block.order[doc],
                                    "tie": block.tie[doc], "start": self.first_start[at].astype(np.uint32)}

    def repeated(self, block: Block, replies: dict, buckets: int) -> np.ndarray:
        """Of each candidate: does its window start earlier elsewhere?"""
        earliest = np.zeros(len(self.key), bool)
        for bucket, at in B.dealt(self.key, buckets):
            at = at[np.lexsort((self.first_start[at], self.first_doc[at]))]
            earliest[at] = replies[WINDOWS, bucket]["yes"]
        g = self.group
        itself = ((block.order[self.doc] == block.order[self.first_doc[g]])
                  & (block.tie[self.doc] == block.tie[self.first_doc[g]]) & (self.start == self.first_start[g]))
        return ~(earliest[g] & itself)


def answer(kind: int, bodies: list[dict]) -> list[dict]:
    """Anchors: does another block have it?  Copies: is there an earlier one?
    Windows: is this the earliest?"""
    sizes = np.cumsum([0, *(len(b["key"]) for b in bodies)])
    whole = {name: np.concatenate([b[name] for b in bodies]) for name in bodies[0]}
    yes = np.zeros(sizes[-1], bool)
    if kind == ANCHORS:
        order = np.argsort(whole["key"], kind="stable")
        same = whole["key"][order][1:] == whole["key"][order][:-1]
        yes[order[1:]] |= same
        yes[order[:-1]] |= same
    else:
        extra = [whole["start"]] if kind == WINDOWS else []
        second = whole["check"] if kind == WINDOWS else whole["low"]
        order = np.lexsort((*extra, whole["tie"], whole["order"], second, whole["key"]))
        new = np.ones(len(order), bool)
        for column in (whole["key"], second):
            new[1:] &= column[order][1:] == column[order][:-1]
        new[1:] = ~new[1:]
        head = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
        first = np.ones(len(order), bool)
        for column in (whole["order"], whole["tie"], *extra):
            first &= column[order] == column[head]
        yes[order] = first if kind == WINDOWS else ~first
    return [{"yes": yes[a:b]} for a, b in zip(sizes, sizes[1:], strict=False)]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256 (of the kept
    words joined by one space).

    NULL and empty texts have no words.  A NULL id comes before all others; rows
    of one id are ordered by a hash of their texts; rows alike in id and text are
    one document and get the same result.  Texts under 20 words lose nothing."""
    texts = B.write_blocks(df, id_col, text_col)
    buckets = B.n_buckets(texts)

    def windows(block, body, replies):
        rows = Block(body)
        for bucket, kind, columns in rows.candidates(replies, buckets).ask(rows, buckets):
            yield B.request(bucket, block, kind, columns)

    def results(_, body, replies):
        rows = Block(body)
        found = rows.candidates(replies, buckets)
        gone = found.repeated(rows, replies, buckets)
        by_doc = np.argsort(found.doc[gone], kind="stable")
        doc, start = found.doc[gone][by_doc], found.start[gone][by_doc]
        removed, digests = [], []
        for i, text in enumerate(rows.texts):
            words = text.split()
            a, b = np.searchsorted(doc, [i, i + 1])
            n = len(words)
            if i in found.copies:
                words = []
            elif b > a:
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, start[a:b], 1)
                np.add.at(edge, start[a:b] + WINDOW, -1)
                words = [w for w, c in zip(words, np.cumsum(edge[:n]).tolist(), strict=True) if not c]
            removed.append(n - len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array(rows.ids, pa.int64()),
            "n_words": pa.array([len(h) for h in rows.hashes], pa.int64()),
            "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})

    anchors = B.answers_to(B.requests_of(texts, lambda body: Block(body).ask_anchors(buckets)), answer)
    earliest = B.answers_to(B.meet(texts, anchors, windows, B.REQUEST), answer)
    return B.meet(texts, anchors.unionByName(earliest), results, RESULT).withColumnRenamed("doc_id", id_col)

"""Language-model scores by a weighted backoff automaton.

The model is a smoothed n-gram model over words, bigrams unless a caller asks for
longer ones: with ``c`` counts in the training texts,

    P1(w)    = (c(w) + 1) / (N + V + 1)               the start state's arcs
    Pk(w|h)  = (c(h w) + mass * Pk-1(w|h')) / (c(h) + mass)

where ``h`` are the ``k - 1`` words before and ``h'`` all of them but the first.
Each history ``h`` that occurs is a state; its arcs are the n-grams ``h w`` that
occur, and its failure arc, of weight ``mass / (c(h) + mass)``, leads to the state
of ``h'``: from trigram states to bigram states, from these to the start state,
where every word has an arc (unknown words share one).  Probabilities of each
state add up to 1.  One traversal from left to right carries the states and adds up
logarithms; an arc's target depends on its n-gram alone, so a whole block is
traversed with arrays, level by level.

All n-grams of all training texts are counted; counts reach the texts by block
requests (``medspark.llm.blocks``), so no table of the corpus is broadcast.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medspark.llm import blocks as B
from medspark.llm.storage import written
from medspark.llm.texts import hashed_texts

FOLDS, HELD_OUT = 7, 2
MASS = 30.0  # words' worth of unigram belief in each state
ORDER = 2  # words of the longest n-grams
END, BEGIN = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949C7DEFAC17B27)
WORDS = 0  # kind of a request for words; that for n-grams is n - 1
RESULT = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
          "base_score double, score double")


def held_out(doc_id) -> bool:
    """By the crc32 of the id as text (NULL: the empty text)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    x = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (after + (before >> np.uint64(31)))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Block:
    """Tokens of a block's texts, each text closed by END, and their n-grams; before
    a text stand as many BEGIN as the longest history holds."""

    def __init__(self, body: bytes, order: int = ORDER):
        self.ids, texts = B.block_rows(body)
        parts = list(hashed_texts(texts, lower=True))
        self.sizes = np.array([len(p) + 1 for p in parts], np.int64)
        self.ends = np.cumsum(self.sizes)
        tokens = np.full(int(self.sizes.sum()), END, np.uint64)
        inner = np.ones(len(tokens), bool)
        inner[self.ends - 1] = False
        if parts:
            tokens[inner] = np.concatenate(parts)
        self.held = np.array([held_out(i) for i in self.ids], bool)
        train = np.repeat(~self.held, self.sizes)
        self.starts = np.concatenate(([0], self.ends[:-1])).astype(np.int64)[:len(parts)]
        # of each order: distinct n-grams, which one ends at each token, training counts
        self.grams, self.gram_of, self.gram_counts, keys = [], [], [], tokens
        for n in range(1, order + 1):
            if n > 1:
                keys = pair_keys(self.shifted(keys, self._begun(n - 1)), tokens)
            grams, of = np.unique(keys, return_inverse=True)
            self.grams.append(grams)
            self.gram_of.append(of)
            self.gram_counts.append(np.bincount(of[train], minlength=len(grams)))

    @staticmethod
    def _begun(n: int) -> np.uint64:
        """The key of ``n`` BEGIN."""
        key = np.array([BEGIN])
        for _ in range(n - 1):
            key = pair_keys(key, np.array([BEGIN]))
        return key[0]

    def shifted(self, values: np.ndarray, first) -> np.ndarray:
        """Each token's predecessor's value, ``first`` where texts begin."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.starts] = first
        return out

    def ask(self, buckets: int):
        for kind, (keys, counts) in enumerate(zip(self.grams, self.gram_counts, strict=True)):
            for bucket, at in B.dealt(keys, buckets):
                yield bucket, kind, {"key": keys[at], "count": counts[at].astype(np.uint32)}

    def counts(self, kind: int, replies: dict, buckets: int) -> np.ndarray:
        out = np.zeros(len(self.grams[kind]), np.int64)
        for bucket, at in B.dealt(self.grams[kind], buckets):
            out[at] = replies[kind, bucket]["count"]
        return out


def answer(_: int, bodies: list[dict]) -> list[dict]:
    """Counts in all training texts of each asked key."""
    sizes = np.cumsum([0, *(len(b["key"]) for b in bodies)])
    keys, first, where = np.unique(np.concatenate([b["key"] for b in bodies]), return_index=True,
                                   return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, where, np.concatenate([b["count"] for b in bodies]).astype(np.int64))
    out = total[where]
    owner = np.zeros(len(out), bool)  # of each key, one request
    owner[first] = True
    return [{"count": out[a:b], "owner": owner[a:b]} for a, b in zip(sizes, sizes[1:], strict=False)]


@dataclass
class Level:
    """States of one order: their n-gram arcs and their failure arcs."""

    arc: np.ndarray  # log10 weight of each n-gram's arc; NaN: only the failure arc
    failure: np.ndarray  # log10 weight of the failure arc of the state before each token


def traverse(start: np.ndarray, levels: list[tuple[np.ndarray, Level]]) -> np.ndarray:
    """log10 weight of the path of each token: its arc from the start state, replaced
    level by level by the n-gram's arc, or preceded by the failure arc."""
    steps = start
    for gram_of, level in levels:
        arc = level.arc[gram_of]
        steps = np.where(np.isnan(arc), level.failure + steps, arc)
    return steps


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mass: float = MASS,
                order: int = ORDER) -> DataFrame:
    """One row per input row: fold, token counts, unigram ``base_score`` and the
    model's ``score`` (log10), with n-grams of up to ``order`` words.

    NULL and empty texts are the end token alone.  Rows with a NULL id hash as
    the empty text; repeated rows are counted as often as they stand.  Without
    training texts every token is unknown."""
    texts = B.write_blocks(df, id_col, text_col)
    buckets = B.n_buckets(texts)
    answers = B.answers_to(B.requests_of(texts, lambda body: Block(body, order).ask(buckets)), answer)
    answers = written(answers, "counts")
    n, v = corpus_totals(answers)
    name = F.coalesce(F.col(id_col).cast("bigint").cast("string"), F.lit(""))
    documents = df.where(F.crc32(name.cast("binary")) % FOLDS != HELD_OUT).count()

    def results(_, body, replies):
        rows = Block(body, order)
        if not len(rows.ids):
            return
        words = rows.counts(WORDS, replies, buckets)[rows.gram_of[0]]
        unigram = (words + 1) / (n + v + 1)
        chance, before, levels = unigram, words, []
        for kind in range(1, order):
            held, of = rows.counts(kind, replies, buckets), rows.gram_of[kind]
            history = rows.shifted(before, documents)
            chance = (held[of] + mass * chance) / (history + mass)
            arc = np.full(len(held), np.nan)
            some = held[of] > 0
            arc[of[some]] = np.log10(chance[some])
            levels.append((of, Level(arc, np.log10(mass / (history + mass)))))
            before = held[of]
        steps = traverse(np.log10(unigram), levels)
        base = np.log10((words + 1) / (n + 1 * (v + 1)))
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array(rows.ids, pa.int64()), "held_out": pa.array(rows.held),
            "n_tokens": pa.array(rows.sizes), "n_known": pa.array(np.add.reduceat((words > 0).astype(np.int64), rows.starts)),
            "train_tokens": pa.array(np.full(len(rows.ids), n), pa.int64()),
            "base_score": pa.array(np.add.reduceat(base, rows.starts)),
            "score": pa.array(np.add.reduceat(steps, rows.starts))})

    return B.meet(texts, answers, results, RESULT).withColumnRenamed("doc_id", id_col)


def corpus_totals(answers: DataFrame) -> tuple[int, int]:
    """Training tokens, and distinct ones (two numbers)."""
    def sums(batches):
        for batch in batches:
            n = v = 0
            for body in batch.column(0).to_pylist():
                columns = B.unpacked(body)
                own = columns["count"][columns["owner"]]
                n, v = n + int(own.sum()), v + int((own > 0).sum())
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "v": pa.array([v], pa.int64())})

    row = (answers.where(F.col("kind") == WORDS).select("body").mapInArrow(sums, "n bigint, v bigint")
           .agg(F.sum("n"), F.sum("v")).first())
    return int(row[0] or 0), int(row[1] or 0)

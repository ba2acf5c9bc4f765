"""Benchmark decontamination by the CGK embedding and bit sampling.

The CGK embedding walks over a word sequence of length ``n``: in each of ``3 n``
steps it emits the word it stands on and moves on if a random bit, drawn for the
step and the word, says so.  Sequences at a small edit distance walk together most
of the time, so few positions differ: edit distance becomes Hamming distance.
Items are embedded several times with fresh bits; from each embedding a few
positions form an LSH key.  The longer an item, the fewer positions stay equal, so
the number of repeats and of positions follow from its length: simulated walks of
items with as many edits as count meet at least once with chance ``RECALL``.  Windows of a text, as long as an item, are
embedded with the same bits (one walk serves all lengths: a window's end only turns
what follows into padding) and looked up.  Whatever meets an item is verified by
the exact edit distance.

Windows that can not match are not walked: within ``k`` edits one of ``k + 1``
separate pieces of an item stays whole and moves by ``k`` words at most, so a
window is worth a walk only where a text has such a piece, that far from its start.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medspark.llm.license_scan import words
from medspark.llm.texts import bytes_of, map_rows

MIN_WORDS = 5  # a shorter item has no edits and is found by its words alone
EDITS = 0.2  # of an item's words
RECALL = 0.999  # of windows with as many edits as count
SAMPLED, MOST_REPEATS = 4, 96  # fewer positions where so many would need more repeats
TRIALS, WALKS = 100, 32  # simulated pairs, and walks of each
WALKED = 1 << 16  # steps of windows at a time: 512 windows of 64 words
MAX_PIECE = 4  # a shorter piece than need be rules out less, but nothing wrongly
BLOCK_BYTES = 4 << 20  # of item texts that are held at once; more go in blocks
RESULT = "doc_id bigint, item_id bigint, first_word bigint, last_word bigint, edits bigint"
_PAD = np.uint64(0xD1B54A32D192ED03)


def word_ids(sequence: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, sequence), np.uint64, len(sequence))


def step_bits(symbols: np.ndarray, step: int, seeds: np.ndarray) -> np.ndarray:
    """The walk's random bits of a step: one column for each repeat."""
    x = symbols ^ (seeds + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) & np.uint64(1)).astype(np.int64)


def equal_shares(n: int) -> np.ndarray:
    """Shares of equal walk positions (trial x walk) of items of ``n`` distinct words
    and windows from the true start with ``int(EDITS * n)`` edits: words put in, left
    out or replaced at random places."""
    rng = np.random.Generator(np.random.PCG64(n))
    ours = rng.integers(0, 1 << 63, (TRIALS, n), dtype=np.uint64)
    theirs = np.empty_like(ours)
    for item, window in zip(ours, theirs, strict=True):
        kind = np.full(n, 3)
        kind[rng.choice(n, int(EDITS * n), replace=False)] = rng.integers(0, 3, int(EDITS * n))
        odd = rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64)
        span = [x for k, word, new in zip(kind, item, odd[:, 0], strict=True)
                for x in ((new, word), (), (new,), (word,))[k]]
        window[:] = [*span, *odd[:, 1]][:n]
    ours, theirs = (np.pad(x, ((0, 0), (0, 1)), constant_values=_PAD) for x in (ours, theirs))
    seeds, row = rng.integers(0, 1 << 63, WALKS, dtype=np.uint64), np.arange(TRIALS)[:, None]
    a = b = np.zeros((TRIALS, WALKS), np.int64)
    equal = np.zeros((TRIALS, WALKS))
    for step in range(2 * n):
        x, y = ours[row, a], theirs[row, b]
        equal += x == y
        a, b = (np.minimum(at + step_bits(z, step, seeds), n) for at, z in ((a, x), (b, y)))
    return equal / (2 * n)


@lru_cache(maxsize=None)
def plan(n: int) -> tuple[int, int]:
    """(repeats, positions sampled) for items of ``n`` words: as many positions as
    ``MOST_REPEATS`` allow at ``RECALL``; with one position, as many repeats as it takes."""
    grain = 1 << max(n.bit_length() - 4, 0)  # lengths above 16 share a plan: that of the longest
    if n % grain:
        return plan(n + grain - n % grain)
    shares = equal_shares(n)
    for sampled in range(min(SAMPLED, 2 * n), 0, -1):
        met, repeats = (shares ** sampled).mean(axis=1), 8
        while ((1 - met) ** repeats).mean() > 1 - RECALL and (repeats < MOST_REPEATS or sampled == 1):
            repeats += 4
        if ((1 - met) ** repeats).mean() <= 1 - RECALL:
            break
    return repeats, sampled


def places_of(item: list[bytes]) -> dict[bytes, int]:
    """Each word's places in an item, as bits."""
    found: dict[bytes, int] = {}
    for i, word in enumerate(item):
        found[word] = found.get(word, 0) | 1 << i
    return found


def edits_at(item: list[bytes], text: list[bytes], start: int, most: int,
             places: dict[bytes, int] | None = None) -> tuple[int, int] | None:
    """(edits, end) of the best span of ``text`` from ``start``, if at most ``most``.
    A column of the table of distances is held as bits: where it rises, where it falls."""
    places = places_of(item) if places is None else places
    whole, last = (1 << len(item)) - 1, 1 << len(item) >> 1
    rises, falls, edits = whole, 0, len(item)
    best, stop = (edits, start), min(len(text), start + len(item) + most)
    for end in range(start, stop):
        at = places.get(text[end], 0)
        level = (((at & rises) + rises) ^ rises) | at
        at |= falls
        up, down = falls | whole & ~(level | rises), rises & level
        edits += bool(up & last) - bool(down & last)
        up, down = up << 1 | 1, down << 1
        rises, falls = (down | ~(at | up)) & whole, up & at & whole
        if edits < best[0]:
            best = (edits, end + 1)
        if edits - (stop - end - 1) > most:
            break
    return best if best[0] <= most else None


@dataclass
class Match:
    item: int
    first: int
    last: int
    edits: int


class Index:
    """Pieces and LSH keys of some items."""

    def __init__(self, items: list[tuple[int, bytes]], seed: int = 1):
        rng = random.Random(seed)
        split = [(number, w) for number, text in items if (w := words(text))]
        self.items = [(number, w) for number, w in split if len(w) >= MIN_WORDS]
        #: items under ``MIN_WORDS`` words: numbers by number of words and words
        self.short: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
        for number, w in split:
            if len(w) < MIN_WORDS:
                self.short.setdefault(len(w), {}).setdefault(tuple(w), []).append(number)
        self.plans = {n: plan(n) for n in sorted({len(w) for _, w in self.items})}
        most = max((repeats for repeats, _ in self.plans.values()), default=0)
        self.seeds = np.array([rng.getrandbits(64) for _ in range(most)], np.uint64)
        self.sampled: dict[int, np.ndarray] = {}  # by window length: positions for each repeat
        self.tables: dict[int, dict[tuple[int, int], list[int]]] = {}
        self.vocabulary: dict[bytes, int] = {}
        #: by number of words: each piece's hash, and the (place in its item, item's length) it has
        self.pieces: dict[int, dict[int, set[tuple[int, int]]]] = {}
        for _, w in self.items:
            ids = np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w])
            count = int(EDITS * len(w)) + 1
            size = min(len(w) // count, MAX_PIECE)
            runs, table = self._runs(ids, size), self.pieces.setdefault(size, {})
            for at in range(0, count * size, size):
                table.setdefault(int(runs[at]), set()).add((at, len(w)))
        self.sorted = {size: np.array(sorted(t), np.uint64) for size, t in self.pieces.items()}
        for n, (repeats, sampled) in self.plans.items():
            self.sampled[n] = np.array([sorted(rng.sample(range(2 * n), sampled)) for _ in range(repeats)])
            self.tables[n] = {}
        for place, (_, w) in enumerate(self.items):
            walk = self._walk(word_ids(w), np.zeros(1, np.int64), 2 * len(w), self.plans[len(w)][0])
            for key in enumerate(self._keys(word_ids(w), walk, np.zeros(1, np.int64), len(w))[0].tolist()):
                self.tables[len(w)].setdefault(key, []).append(place)

    @staticmethod
    def _runs(ids: np.ndarray, size: int) -> np.ndarray:
        n = max(len(ids) - size + 1, 0)
        out = np.zeros(n, np.uint64)
        for i in range(size):
            out = (out + ids[i:i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def _walk(self, symbols: np.ndarray, starts: np.ndarray, steps: int, repeats: int | None = None) -> np.ndarray:
        """Places in ``symbols`` at each step, for every start and repeat."""
        padded, seeds = np.append(symbols, _PAD), self.seeds[:repeats]
        at = np.repeat(starts[:, None], len(seeds), axis=1)
        out = np.empty((steps, *at.shape), np.int64)
        for step in range(steps):
            out[step] = at
            at = np.minimum(at + step_bits(padded[at], step, seeds), len(symbols))
        return out

    def _keys(self, symbols: np.ndarray, walk: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """LSH keys (start x repeat) of the windows of ``n`` words."""
        padded, sampled = np.append(symbols, _PAD), self.sampled[n]
        key = np.zeros((len(starts), len(sampled)), np.uint64)
        repeat = np.arange(len(sampled))
        for column in range(sampled.shape[1]):
            place = walk[sampled[:, column], :, repeat].T
            symbol = np.where(place < starts[:, None] + n, padded[place], _PAD)
            key = (key ^ symbol) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key

    def windows(self, text: list[bytes]) -> dict[int, list[int]]:
        """Where windows can start that hold a whole piece, by their length."""
        known = np.fromiter(map(self.vocabulary.get, text, repeat(0)), np.int64, len(text))
        found: dict[int, set[int]] = {}
        for size, pieces in self.sorted.items():
            runs = self._runs(known, size)
            whole = np.ones(len(runs), bool)
            for i in range(size):
                whole &= known[i:i + len(runs)] > 0
            at = np.flatnonzero(whole)
            place = np.searchsorted(pieces, runs[at]).clip(0, len(pieces) - 1)
            for p in at[pieces[place] == runs[at]].tolist():
                for offset, n in self.pieces[size][int(runs[p])]:
                    most = int(EDITS * n)
                    found.setdefault(n, set()).update(range(max(p - offset - most, 0), p - offset + most + 1))
        return {n: sorted(s for s in starts if s < len(text)) for n, starts in found.items()}

    def candidates(self, text: list[bytes]) -> dict[int, set[int]]:
        """Starts, by place of the item that they meet."""
        found: dict[int, set[int]] = {}
        windows = self.windows(text)
        symbols = word_ids(text) if windows else None
        for n, starts in windows.items():
            table = self.tables[n]
            many = max(WALKED // (2 * n), 1)
            for first in range(0, len(starts), many):
                part = np.array(starts[first:first + many])
                keys = self._keys(symbols, self._walk(symbols, part, 2 * n, self.plans[n][0]), part, n)
                for start, row in zip(part.tolist(), keys.tolist(), strict=True):
                    for key in enumerate(row):
                        for place in table.get(key, ()):
                            found.setdefault(place, set()).add(start)
        return found

    def short_matches(self, text: list[bytes], least: int = 1) -> list[Match]:
        """Each item of ``least`` up to ``MIN_WORDS`` words that the text holds: its
        first span."""
        out = []
        for n, items in self.short.items():
            if n < least:
                continue
            seen = set()
            for start, span in enumerate(zip(*(text[i:] for i in range(n)), strict=False)):
                if span in items and span not in seen:
                    seen.add(span)
                    out += [Match(number, start, start + n - 1, 0) for number in items[span]]
        return out

    def matches(self, text: list[bytes], least: int = 1) -> list[Match]:
        """Each item of at least ``least`` words that a span of the text equals within
        its edits: the best span, the earliest of equally good ones."""
        out = self.short_matches(text, least)
        for place, starts in sorted(self.candidates(text).items()):
            number, item = self.items[place]
            if len(item) < least:
                continue
            most, best, in_item = int(EDITS * len(item)), None, places_of(item)
            for start in sorted(starts):
                found = edits_at(item, text, start, most if best is None else best.edits - 1, in_item)
                if found:
                    best = Match(number, start, found[1] - 1, found[0])
                    if not found[0]:
                        break
            if best:
                out.append(best)
        return out


def indexes(items: DataFrame, id_col: str, text_col: str) -> list[Index]:
    """The items in blocks of bounded size, one index for each."""
    rows = items.select(F.col(id_col).cast("bigint").alias("id"),
                        F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    for block in range(blocks):
        held = rows.where(part == block).orderBy("id", "text").collect()
        yield Index([(r["id"], r["text"].encode()) for r in held])


def find_leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item that a span of its text equals within
    ``EDITS`` of the item's words (runs of letters and digits, lower-cased): ids,
    first and last word of the best span, edits.

    Items under ``MIN_WORDS`` words allow no edits and match exactly.  NULL texts and
    items and those without words match nothing; repeated documents and items give a row each; clean documents none.
    NULL ids pass through.  All items are tried, block by block."""
    docs = df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string").cast("binary"))
    found = None
    for index in indexes(items, item_col, item_text_col):
        held = df.sparkSession.sparkContext.broadcast(index)

        def run(batches, held=held):
            for batch in batches:
                rows = [(d, m.item, m.first, m.last, m.edits)
                        for d, text in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), strict=True)
                        for m in held.value.matches(words(text))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)],
                    [f.split()[0] for f in RESULT.split(", ")])

        part = docs.mapInArrow(run, RESULT)
        found = part if found is None else found.unionByName(part)
    return found.withColumnsRenamed({"doc_id": id_col, "item_id": item_col})


def keep_clean(df: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", least_words: int = 1) -> DataFrame:
    """The rows of ``df``, all columns, whose texts match no item of at least
    ``least_words`` words."""
    for index in indexes(items, item_col, item_text_col):
        held = df.sparkSession.sparkContext.broadcast(index)

        def clean(batch, place, held=held):
            keep = [x is None or not held.value.matches(words(x.encode()), least_words)
                    for x in batch.column(place).to_pylist()]
            return batch.filter(pa.array(keep, pa.bool_()))

        df = map_rows(df, clean, text_col)
    return df

"""Ranked lexical search: NRA over impact-sorted posting lists.

The index is a table of shards, runs of documents of bounded size; a shard holds
its documents' lengths and, term by term, the documents with the term and how
often it occurs there.  So a term's postings are spread over all shards, however
frequent it is.  Scores depend on counts of the whole corpus, which are sums over
the shards.

Within a shard every item is answered by NRA ("no random access").  Its lists,
sorted by impact, are read from the top, some postings of each at a time.  What
was read of a document is the lower end of its score; the upper end adds, for
each list in which it wasn't met, the impact at which that list stands.  Reading
goes on until no document can still reach the k best but those whose two ends have
met: membership, ties and scores are then final.  A task carries each item's k
best through its shards, so later shards stop earlier, and sends k rows an item.

Items come in blocks; a round of the search takes blocks of a bounded size, which
are broadcast, and passes over the index, not over the texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medspark.llm.blocks import packed, unpacked
from medspark.llm.storage import written
from medspark.llm.texts import bytes_of, chunks, slices, word_hashes

TOP = 10
SHARD_BYTES = 16 << 20  # of texts; a longer text makes its own shard
ITEM_BLOCK_BYTES = 256 << 10  # of items' texts; a longer item makes its own block
ROUND_BYTES = 32 << 20  # of packed blocks that are broadcast at once; a larger block is sent alone
FIRST_READ = 256  # postings of each list; every later read takes twice as many
LONG = 1 << 20  # bytes; longer texts are hashed in parts
# Bytes that part terms (all ASCII but letters and digits).
_GAPS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def parts_of(text: bytes) -> list[bytes]:
    """``text``, if long cut before bytes that part terms."""
    if len(text) <= LONG:
        return [text]
    parts, first = [], 0
    while first + LONG < len(text) and (gap := _GAP.search(text, first + LONG)):
        parts.append(text[first:gap.start()])
        first = gap.start()
    return [*parts, text[first:]]


def term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all terms of ``texts`` in order, and the number of each one's text."""
    parts = [(i, p) for i, t in enumerate(texts) for p in parts_of(t)]
    number, rows = np.array([i for i, _ in parts], np.int64), [p for _, p in parts]
    found, of = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for a, b in chunks(rows):
        hashes, counts = word_hashes(rows[a:b], True, _GAPS)
        found.append(hashes)
        of.append(np.repeat(number[a:b], counts))
    return np.concatenate(found), np.concatenate(of)


def postings(terms: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, occurrences), ordered by term and document; ``docs`` ascend."""
    order = np.argsort(terms, kind="stable")
    terms, docs = terms[order], docs[order]
    first = np.flatnonzero(np.concatenate(([True], (terms[1:] != terms[:-1]) | (docs[1:] != docs[:-1])))[:len(terms)])
    return terms[first], docs[first], np.diff(np.append(first, len(terms)))


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(n_docs, n_terms, docs, terms, postings), a row for each shard, written.
    Documents without terms are in no shard."""
    def run(batches):
        held, size = [], 0

        def shard():
            ids = pa.concat_arrays([i for i, _, _ in held])
            before = np.cumsum([0, *[len(i) for i, _, _ in held]])
            docs = np.concatenate([of + b for (_, _, of), b in zip(held, before, strict=False)])
            lengths = np.bincount(docs, minlength=len(ids))
            used = np.flatnonzero(lengths)
            term, doc, n = postings(np.concatenate([t for _, t, _ in held]), (np.cumsum(lengths > 0) - 1)[docs])
            first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))[:len(term)])
            ids = ids.take(pa.array(used))
            bodies = (packed({"id": ids.fill_null(0), "named": ids.is_valid(), "length": lengths[used]}),
                      packed({"term": term[first], "df": np.diff(np.append(first, len(term)))}),
                      packed({"doc": doc.astype(np.int32), "tf": n.astype(np.int32)}))
            return pa.RecordBatch.from_arrays(
                [pa.array([len(used)], pa.int64()), pa.array([len(docs)], pa.int64()),
                 *[pa.array([b], pa.binary()) for b in bodies]], ["n_docs", "n_terms", "docs", "terms", "postings"])

        for batch in (part for whole in batches for part in slices(whole, 1)):
            texts = bytes_of(batch.column(1))
            more = sum(map(len, texts)) + 16 * len(texts)
            if held and size + more > SHARD_BYTES:
                yield shard()
                held, size = [], 0
            held.append((batch.column(0), *term_hashes(texts)))
            size += more
        if held:
            yield shard()

    rows = df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string").cast("binary"))
    return written(rows.mapInArrow(run, "n_docs bigint, n_terms bigint, docs binary, terms binary, postings binary"),
                   "index")


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, items, terms), written: ids of the block's items; their distinct terms
    with the item's number and the term's repeats in it."""
    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, first, size = bytes_of(batch.column(1)), 0, 0
            for i in range(len(texts) + 1):
                if i == len(texts) or size and size + len(texts[i]) > ITEM_BLOCK_BYTES:
                    terms, of = term_hashes(texts[first:i])
                    term, item, n = postings(terms, of)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number], pa.int64()),
                         pa.array([packed({"id": batch.column(0).slice(first, i - first)})], pa.binary()),
                         pa.array([packed({"term": term, "item": item, "repeats": n})], pa.binary())],
                        ["block", "items", "terms"])
                    first, number, size = i, number + 1, 0
                size += len(texts[i]) + 1 if i < len(texts) else 0

    rows = items.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string").cast("binary"))
    return written(rows.mapInArrow(run, "block bigint, items binary, terms binary"), "items")


def rounds_of(blocks: DataFrame) -> Iterator[list[int]]:
    """Block numbers that are broadcast together."""
    held, size = [], 0
    for row in blocks.select("block", (F.length("items") + F.length("terms")).alias("size")).orderBy("block").collect():
        if held and size + row["size"] > ROUND_BYTES:
            yield held
            held, size = [], 0
        held.append(row["block"])
        size += row["size"]
    if held:
        yield held


def _met(index: DataFrame, blocks: DataFrame, numbers: list[int]) -> DataFrame:
    """Every shard with each of the named blocks, which are of bounded size together."""
    some = blocks.where(F.col("block").isin(numbers))
    return index.withColumn("block", F.explode(F.lit(numbers).cast("array<bigint>"))).join(F.broadcast(some), "block")


def document_counts(index: DataFrame, blocks: DataFrame, numbers: list[int]) -> DataFrame:
    """(block, term, df) of the blocks' terms that occur; term as signed bits."""
    def run(batches):
        for batch in batches:
            for block, own, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, terms = unpacked(own), np.unique(unpacked(asked)["term"])
                at = np.flatnonzero(np.isin(own["term"], terms, assume_unique=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), block)), pa.array(own["term"][at].view(np.int64)),
                     pa.array(own["df"][at].astype(np.int64))], ["block", "term", "df"])

    pairs = _met(index.select("terms"), blocks.select("block", F.col("terms").alias("asked")), numbers)
    return (pairs.select("block", "terms", "asked").mapInArrow(run, "block bigint, term bigint, df bigint")
            .groupBy("block", "term").agg(F.sum("df").alias("df")))


def weighted(blocks: DataFrame, counts: DataFrame, n_docs: int) -> DataFrame:
    """(block, items, terms): terms that occur, with the item's number and the weight
    times the repeats; written.  A group is one block's terms."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select(["block", "items", "terms"])
        terms = unpacked(left.column("terms")[0].as_py())
        held = right.column("term").to_numpy().view(np.uint64)
        order = np.argsort(held)
        held, df = held[order], right.column("df").to_numpy()[order]
        kept = np.isin(terms["term"], held)
        term, item, repeats = (terms[c][kept] for c in ("term", "item", "repeats"))
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        body = packed({"term": term, "item": item, "weight": repeats * weight[np.searchsorted(held, term)]})
        return pa.table({"block": left.column("block"), "items": left.column("items"),
                         "terms": pa.array([body], pa.binary())})

    return written(blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(
        run, "block bigint, items binary, terms binary"), "weights")


def nra(lists: list[tuple[np.ndarray, np.ndarray, int]], n_docs: int, top: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents, with scores, that may be among the ``top`` best and score at least
    ``least``: all whose score is at least the last of these.

    ``lists``: for each term of the item, documents and impacts (descending) and the
    weight by which impacts count."""
    low, depth, step = np.zeros(n_docs, np.int64), 0, FIRST_READ
    while True:
        frontier = []
        for docs, impacts, weight in lists:
            read = slice(depth, depth + step)
            low[docs[read]] += weight * impacts[read]
            frontier.append(weight * int(impacts[depth + step]) if depth + step < len(docs) else 0)
        depth += step
        step *= 2
        bar = max(least, int(np.partition(low, -top)[-top]) if n_docs > top else 0)
        unread = sum(frontier)
        met = np.zeros(n_docs, np.int64)  # of the frontier, what a document was met with
        for (docs, _, _), at in zip(lists, frontier, strict=True):
            if at:
                met[docs[:depth]] += at
        able = np.flatnonzero(low + (unread - met) >= bar)
        if (met[able] == unread).all():
            return able, low[able]


class Shard:
    """A shard's documents and the impact-sorted lists of some terms."""

    def __init__(self, docs: bytes, terms: bytes, body: bytes, asked: np.ndarray, n_docs: int, n_terms: int):
        docs, own, body = unpacked(docs), unpacked(terms), unpacked(body)
        self.ids, self.named = docs["id"], docs["named"]
        m = np.array([25 + 75 * n * n_docs // n_terms for n in docs["length"].tolist()], np.int64)
        at = np.flatnonzero(np.isin(own["term"], asked, assume_unique=True))
        start = np.cumsum(own["df"]) - own["df"]
        size = own["df"][at]
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) + np.repeat(start[at] - first, size)
        doc, tf = body["doc"][place], body["tf"][place].astype(np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        order = np.lexsort((-impact, np.repeat(np.arange(len(at)), size)))
        doc, impact = doc[order], impact[order]
        self.lists = {term: (doc[a:a + n], impact[a:a + n])
                      for term, a, n in zip(own["term"][at].tolist(), first.tolist(), size.tolist(), strict=True)}


def ordered(best: tuple[np.ndarray, ...], more: tuple[np.ndarray, ...], top: int) -> tuple[np.ndarray, ...]:
    """The ``top`` best of both (score, id, id is given): score descending, id
    ascending with NULL first."""
    score, ids, named = (np.concatenate(x) for x in zip(best, more, strict=True))
    order = np.lexsort((ids, named, -score))[:top]
    return score[order], ids[order], named[order]


def best_in_tasks(index: DataFrame, blocks: DataFrame, numbers: list[int], n_docs: int, n_terms: int,
                  top: int) -> DataFrame:
    """(block, item, item_id, doc_id, score): the best of each item within each task."""
    def run(batches):
        best, named, none = {}, {}, (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
        for batch in batches:
            for block, docs, terms, body, items, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block not in named:
                    named[block] = pa.ipc.open_stream(items).read_all().column("id").to_pylist()
                asked = unpacked(asked)
                if not len(asked["term"]):
                    continue
                shard = Shard(docs, terms, body, np.unique(asked["term"]), n_docs, n_terms)
                order = np.argsort(asked["item"], kind="stable")
                items, first = np.unique(asked["item"][order], return_index=True)
                for item, places in zip(items.tolist(), np.split(order, first[1:]), strict=True):
                    lists = [(*shard.lists[t], w) for t, w in zip(
                        asked["term"][places].tolist(), asked["weight"][places].tolist(), strict=True)
                        if w and t in shard.lists]
                    if not lists:
                        continue
                    so_far = best.get((block, item), none)
                    able, found = nra(lists, len(shard.ids), top, int(so_far[0][-1]) if len(so_far[0]) == top else 1)
                    if len(able):
                        best[block, item] = ordered(so_far, (found, shard.ids[able], shard.named[able]), top)
        for (block, item), (score, ids, given) in best.items():
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * n, pa.int64()), pa.array([item] * n, pa.int64()),
                 pa.array([named[block][item]] * n, pa.int64()), pa.array(ids, pa.int64(), mask=~given), pa.array(score)],
                ["block", "item", "item_id", "doc_id", "score"])

    pairs = _met(index.select("docs", "terms", "postings"),
                 blocks.select("block", "items", F.col("terms").alias("asked")), numbers)
    return pairs.select("block", "docs", "terms", "postings", "items", "asked").mapInArrow(
        run, "block bigint, item bigint, item_id bigint, doc_id bigint, score bigint")


def search(index: DataFrame, items: DataFrame, top: int = TOP, item_id_col: str = "item_id",
           item_text_col: str = "text") -> DataFrame:
    """Each item's ``top`` best documents of ``build_index``: item_id, rank, doc_id, score."""
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    blocks, found = item_blocks(items, item_id_col, item_text_col), None
    for numbers in rounds_of(blocks):
        counts = document_counts(index, blocks, numbers)
        ready = weighted(blocks.where(F.col("block").isin(numbers)), counts, n_docs or 0)
        more = best_in_tasks(index, ready, numbers, n_docs or 0, n_terms or 0, top)
        found = more if found is None else found.unionByName(more)
    if found is None:
        found = items.sparkSession.createDataFrame(
            [], "block bigint, item bigint, item_id bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select(F.col("item_id").alias(item_id_col), "rank", "doc_id", "score"))


def rank_documents(df: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                   item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each item and each of its ``top`` best documents with a score above 0.

    NULL and empty texts have no terms: such documents are never found, such items
    find nothing.  Equal scores rank by ascending id, NULL first, repeated rows of one
    id in any order.  Every row of either table counts by itself, whatever its id.
    Empty tables give no rows; other columns aren't read."""
    return (search(build_index(df, id_col, text_col), items, top, item_id_col, item_text_col)
            .withColumnRenamed("doc_id", id_col))

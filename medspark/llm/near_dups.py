"""Near-duplicates by HyperMinHash registers.

A document's set holds its distinct 5-word shingles.  One 64-bit hash of each
shingle chooses one of ``BUCKETS`` registers by its top bits; a register stores,
of the smallest remainder seen, the number of leading zeros and the next
``MANTISSA`` bits (16 bits in all).  Empty registers borrow from others in a fixed
random order, so small sets compare as well.

Bands of six compressed registers propose pairs; the share of equal registers,
corrected for accidental collisions, estimates the Jaccard similarity; pairs that
can't reach the threshold are dropped and the rest are confirmed on full sets.

A band's bucket never emits all its pairs.  Its most central member (the one that
meets most others over all bands) leads, and the members are compared with it.
Buckets whose members then lie in one component are settled.  In the others all
pairs of members of different components are estimated, in tiles of bounded size
that hold the registers as arrays; only pairs within reach of the threshold, each
from the first band that it shares, leave a tile and are confirmed.  So every link
between different components is found, and components stay whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medspark.llm.storage import scratch, written
from medspark.llm.texts import bytes_of, fresh, hashed_texts, joined, map_texts

SHINGLE = 5
PERCENT = 85  # of the union that linked sets share, unless a caller asks for another share
BUCKETS, MANTISSA = 256, 10
BAND = 6  # registers
BANDS = BUCKETS // BAND  # a pair at 0.85 shares none with chance (1 - 0.85^6)^42: 2e-9, at 0.8 3e-6
DEVIATIONS = 5  # of an estimate, below the threshold, that still count as within reach
TILE = 1024  # members of a bucket compared with as many
_REST = 64 - 8
_rng = np.random.Generator(np.random.PCG64(7))
_LENDERS = np.array([_rng.permutation(BUCKETS) for _ in range(BUCKETS)])


def registers(shingles: np.ndarray) -> np.ndarray:
    """Registers (0: empty) of a set of distinct, sorted 64-bit hashes."""
    out = np.zeros(BUCKETS, np.uint16)
    bucket = (shingles >> np.uint64(_REST)).astype(np.int64)
    used, first = np.unique(bucket, return_index=True)
    rest = shingles[first] & np.uint64((1 << _REST) - 1)  # the smallest: hashes are sorted
    shifted = np.maximum(rest, 1)
    length = np.floor(np.log2(shifted.astype(np.float64))).astype(np.int64) + 1
    length -= (shifted >> np.minimum(length - 1, 63).astype(np.uint64)) == 0  # rounding of large numbers
    zeros = np.minimum(_REST - length, 62)
    drop = length - 1 - MANTISSA
    after = np.where(drop >= 0, shifted >> np.maximum(drop, 0).astype(np.uint64),
                     shifted << np.maximum(-drop, 0).astype(np.uint64))
    out[used] = (((zeros + 1) << MANTISSA) | (after.astype(np.int64) & ((1 << MANTISSA) - 1))).astype(np.uint16)
    return out


def filled(own: np.ndarray) -> np.ndarray:
    """Empty registers replaced by the first used one in their lenders' order."""
    if own.all() or not own.any():
        return own
    empty = np.flatnonzero(own == 0)
    lender = _LENDERS[empty]
    return_at = np.argmax(own[lender] > 0, axis=1)
    out = own.copy()
    out[empty] = own[lender[np.arange(len(empty)), return_at]]
    return out


def accidental(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that unlike minima of sets of ``n`` and ``m`` share a register
    value: the published approximation 0.1699 * 2^-r * 4nm / (n + m)^2."""
    return 0.169919487 * 2.0 ** -MANTISSA * 4 * n * m / (n + m) ** 2


def estimates(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity of pairs from unfilled registers (rows) and set sizes."""
    either = np.maximum(((a > 0) | (b > 0)).sum(axis=1), 1)
    equal = ((a == b) & (a > 0)).sum(axis=1) / either
    chance = accidental(n, m)
    return (equal - chance) / (1 - chance)


def within_reach(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Can these pairs be linked?  By sizes, and by the estimate: the registers in
    use sample the union without replacement."""
    least = percent / 100
    used = np.maximum(((a > 0) | (b > 0)).sum(axis=1), 1)
    unseen = np.clip(1 - used * (1 + least) / (n + m), 0.02, 1)
    deviation = np.sqrt(least * (1 - least) * unseen / used)
    return (estimates(a, b, n, m) >= least - DEVIATIONS * deviation - 1 / used) & (
        100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def word_sets(text: bytes, size: int = SHINGLE) -> set[tuple[bytes, ...]]:
    """A text's distinct shingles: of ``size`` words, or of all if fewer."""
    words = text.lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size)), strict=False))


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, words' key, registers) of each row."""
    def make():
        def columns(texts):
            sizes, keys, found = [], [], []
            for text, words in zip(texts, hashed_texts(texts, lower=True), strict=True):
                width = min(len(words), SHINGLE)
                shingles = np.unique(joined(words, width)) if width else np.empty(0, np.uint64)
                sizes.append(len(shingles))
                keys.append(xxhash.xxh3_128_digest(b" ".join(text.lower().split())) if width else None)
                found.append(registers(shingles).tobytes() if width else None)
            return [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.binary())]
        return columns

    return map_texts(df, make, "n_shingles bigint, words binary, registers binary", id_col, text_col)


def bands_of(own: np.ndarray) -> np.ndarray:
    """Keys of the bands of each row of registers."""
    full = np.array([filled(r) for r in own]).reshape(len(own), BUCKETS)[:, :BANDS * BAND].astype(np.uint64)
    full = full.reshape(len(own), BANDS, BAND)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), full.shape[:2])
    for i in range(BAND):
        key = (key ^ full[:, :, i]) * np.uint64(0xD6E8FEB86659FD93)
        key = key ^ (key >> np.uint64(31))
    return key.astype(np.int64)


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def band_keys(sets: DataFrame) -> DataFrame:
    """(key, id) of each band of each set."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(bands_of(_registers(batch.column(1))).ravel()),
                 pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "id"])

    return sets.select("id", "registers").mapInArrow(run, "key bigint, id bigint")


def likely(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose estimate leaves the threshold within reach."""
    def run(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy().astype(np.float64) for c in ("na", "nb"))
            near = within_reach(*(_registers(batch.column(c)) for c in ("ra", "rb")), n, m, percent)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    def side(x):
        return sets.select(F.col("id").alias(x), F.col("registers").alias(f"r{x}"), F.col("n_shingles").alias(f"n{x}"))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a bigint, b bigint")


def likely_in_tiles(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of members (key, id, component, n_shingles, registers, tiles) of
    one key and different components that are within reach; each pair from the
    first band that it shares."""
    sides = ["key", "low", "high"]
    tile = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    rows = (members.withColumn("tile", tile)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles").cast("int") - 1)))
            .select("key", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile",
                    "id", "component", "n_shingles", "registers"))

    def compared(name, held):
        """All pairs of a tile with itself (low = high) or with another one."""
        key, low, high = name
        table = pa.Table.from_batches(held)
        tile, ids, component, sizes = (table.column(c).to_numpy() for c in ("tile", "id", "component", "n_shingles"))
        sizes, own, bands, found = sizes.astype(np.float64), _registers(table.column("registers")), None, []
        for i in range(len(ids)):
            other = component != component[i]
            other[:i + 1] = False
            if low != high:
                other &= tile != tile[i]
            at = np.flatnonzero(other & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])))
            at = at[within_reach(own[i][None], own[at], np.full(len(at), sizes[i]), sizes[at], percent)]
            if len(at):
                bands = bands_of(own) if bands is None else bands
                at = at[bands[i][np.argmax(bands[at] == bands[i], axis=1)] == key]
                found += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in at.tolist()]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches):
        held, name = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in sides]
            change = np.zeros(batch.num_rows - 1, bool)
            for c in columns:
                change |= c[1:] != c[:-1]
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                here = tuple(int(c[a]) for c in columns)
                if held and here != name:
                    yield compared(name, held)
                    held = []
                name = here
                held.append(batch.slice(a, b - a))
        if held:
            yield compared(name, held)

    return rows.repartition(*sides).sortWithinPartitions(*sides).mapInArrow(run, "a bigint, b bigint")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    def run(batches):
        last, known = None, set()
        for batch in batches:
            keep = []
            for b, ta, tb in zip(batch.column(1).to_pylist(), bytes_of(batch.column(2)), bytes_of(batch.column(3)),
                                 strict=True):
                if b != last:
                    last, known = b, word_sets(tb)
                own = word_sets(ta)
                both = len(own & known)
                keep.append(100 * both >= percent * (len(own) + len(known) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def side(x):
        return texts.select(F.col("id").alias(x), F.col("text").alias(f"t{x}"))

    return (pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
            .mapInArrow(run, "a bigint, b bigint"))


def components(links: DataFrame) -> DataFrame:
    """(id, component), written: the smallest id reachable, for ids that have links.

    Every round each id takes the smallest label among itself and its
    neighbours, then the label of that label; rounds are written tables."""
    with scratch(links.sparkSession) as keep:
        both = keep(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
        labels = keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
        while True:
            near = (both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id"))
                    .agg(F.min("label").alias("near")))
            step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
            up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
            new = keep(step.join(up, "label").select("id", "old", F.least("label", "up").alias("label")), "labels")
            if new.where(F.col("old") != F.col("label")).isEmpty():
                return written(new.select("id", F.col("label").alias("component")), "components")
            labels = new.select("id", "label")


def components_of(sets: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the sets that have links."""
    with scratch(sets.sparkSession) as keep:
        keys = band_keys(sets)
        shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        members = keep(keys.join(shared, "key"), "members")
        central = members.groupBy("id").agg(F.sum("size").alias("met"))
        leaders = (members.join(central, "id").groupBy("key")
                   .agg(F.max_by("id", F.struct("met", -F.col("id"))).alias("leader")))
        led = keep(members.select("key", "id").join(leaders, "key"), "led")

        texts = keep(texts.join(led.select("id").distinct(), "id", "left_semi"), "candidates")
        pairs = led.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
        links = keep(confirmed(keep(likely(pairs, sets, percent), "pairs"), texts, percent), "links")
        found = components(links)

        placed = led.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = (placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"),
                                           F.count(F.lit(1)).alias("size"))
                 .where("c0 < c1").select("key", F.ceil(F.col("size") / TILE).alias("tiles")))
        sketched = sets.select("id", "n_shingles", "registers")
        rest = likely_in_tiles(placed.select("key", "id", "component").join(mixed, "key").join(sketched, "id"), percent)
        more = keep(confirmed(keep(rest, "pairs"), texts, percent), "links")
        return found if more.isEmpty() else components(links.union(more))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Documents are linked that share at least ``percent`` of their union.  A NULL text has no words; documents without words are linked with nothing.
    Rows of one id count as one document if their words are alike and as linked
    documents otherwise.  A NULL id is never linked: component_id is NULL, kept
    is true.  Extra columns are not read."""
    rows = written(signatures(df, id_col, text_col).withColumnRenamed(id_col, "id"), "signatures")
    # documents with the same words: one set, named by its smallest id
    sets = written(rows.where(F.col("words").isNotNull() & F.col("id").isNotNull()).groupBy("words").agg(
        F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")),
        "sets")
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    found = components_of(sets, texts, percent)

    named = sets.select("words", F.col("id").alias("name")).join(
        found.withColumnRenamed("id", "name"), "name", "left")
    joined_rows = rows.join(named, "words", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "name", "id"))
    return joined_rows.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``df``, all columns, without documents whose component has a
    smaller id.  Rows alike in id and text are one document and stay together."""
    name = fresh(df, "gone")
    gone = written(near_duplicates(df, id_col, text_col, percent).where(~F.col("kept")).select(
        F.col(id_col).alias(name)), "gone")
    return df.join(gone, F.col(id_col).cast("bigint") == F.col(name), "left_anti")

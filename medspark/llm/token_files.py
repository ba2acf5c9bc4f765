"""Token ids as Parquet files with list columns.

Rows are range-partitioned and sorted by id; each file holds one range.  Ids are
dictionary-encoded (delta-encoded where a dictionary would be too large), offsets
and counts delta- or dictionary-encoded; row groups and pages have a set size and
the page index lets a reader fetch the ids of a few documents, or the metadata
columns alone, without reading the rest.

Columns: the id, ``part`` (number of the range), ``offset`` (ids of the range
before this row), ``n_tokens``, ``tokens``.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medspark.llm.texts import slices

END_ID = 2
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
CACHE_ENTRIES = 300_000  # pieces that one Python worker keeps, twice at most; others are encoded again
#: Blanks beyond ASCII, and controls that are blanks to some: texts with them are encoded whole
_BLANKS = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Kinds of bytes: letters, digits, signs, blanks; apostrophes and bytes beyond ASCII may be several and have their bits
_LETTER, _DIGIT, _SIGN, _BLANK = 1, 2, 4, 8
_KIND = bytes(
    _BLANK if c in b" \t\n\r\x0b\x0c" else _LETTER | _DIGIT | _SIGN if c > 127 or c == ord("'") else
    _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _SIGN for c in range(256))


def _piece_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin that lie one after another in ``data``.

    The pattern of byte-level BPE always parts letters, digits, signs and blanks;
    the last blank before a word is parted from those before it and, if it is the
    plain one, opens the word.  Where a byte may be of several kinds nothing is cut,
    so a piece may hold more than one match, never a part of one."""
    kind = np.frombuffer(data.tobytes().translate(_KIND), np.uint8)
    cut = np.ones(len(data), bool)
    np.equal((kind[:-1] | (data[:-1] == 32) * np.uint8(7)) & kind[1:], 0, out=cut[1:])
    blank, word = kind == _BLANK, kind != _BLANK
    word[starts] = False
    cut[1:-1] |= blank[:-2] & blank[1:-1] & word[2:]
    cut[starts] = True
    return np.flatnonzero(cut)


class IdEncoder:
    """Ids of a byte-level BPE vocabulary: those of a text are those of its pieces,
    one after another.  The pieces of some texts that are not known go to the library
    as one text, one to a line."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._encode = tokenizer.encode_batch_fast
        special = [re.escape(x.content) for x in tokenizer.get_added_tokens_decoder().values()]
        self._whole = "|".join([_BLANKS, *special])
        self._line = self._ids("\n")[0]
        self._known, self._older = {}, {}  # pieces used lately; twice CACHE_ENTRIES and a slice's at most

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self._encode([text], add_special_tokens=False)[0].ids, "<u4")

    def _ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each of ``pieces``, which are then known."""
        if len(self._known) > CACHE_ENTRIES:
            self._known, self._older = {}, self._known
        ids = [*map(self._known.get, pieces)]
        if missing := [i for i, x in enumerate(ids) if x is None]:
            new = []
            for i in missing:
                ids[i] = self._older.get(pieces[i])
                if ids[i] is None:
                    if pieces[i].isspace():
                        ids[i] = self._ids(pieces[i].decode()).tobytes()
                    else:
                        new.append(i)
            if new:
                lines = self._ids("\n".join([pieces[i].decode() for i in new]))
                ends, raw = (4 * np.flatnonzero(lines == self._line)).tolist(), lines.tobytes()
                for i, a, b in zip(new, [0, *(x + 4 for x in ends)], [*ends, len(raw)], strict=True):
                    ids[i] = raw[a:b]
            self._known.update((pieces[i], ids[i]) for i in missing)
        return ids

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by ``end_id``, and how many each has.  Every
        text is a list of numbered parts: its pieces and the end, or all of it with
        the end, if it can't be cut."""
        whole = pa.compute.match_substring_regex(texts, self._whole)
        end = np.asarray([end_id], "<u4").tobytes()
        rest = [self._ids(t).tobytes() + end for t in texts.filter(whole).to_pylist()]
        texts = pa.compute.if_else(whole, "", texts)
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(data or b"", np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        starts = _piece_starts(data, offsets[offsets < len(data)]).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [
            None, pa.py_buffer(np.append(starts, np.int32(len(data)))), pa.py_buffer(data)]).dictionary_encode()
        parts = self._ids_of(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        closing = np.full(len(texts), len(parts))
        closing[whole.to_numpy(zero_copy_only=False)] += 1 + np.arange(len(rest))
        ends = np.searchsorted(starts, offsets[1:])
        number = np.insert(pieces.indices.to_numpy().astype(np.int64), ends, closing)
        taken = pa.array([*parts, end, *rest], pa.large_binary()).take(pa.array(number))
        _, places, ids = taken.buffers()
        ends = np.frombuffer(places, np.int64)[np.append(0, ends + 1 + np.arange(len(ends)))] // 4
        return np.frombuffer(ids, "<u4", ends[-1]), np.diff(ends)


_ENCODERS: dict[str, IdEncoder] = {}


def id_encoder(path: str) -> IdEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = IdEncoder(path)
    return _ENCODERS[path]


def write_token_files(df: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = END_ID, row_group_bytes: int = ROW_GROUP_BYTES,
                      page_bytes: int = PAGE_BYTES) -> None:
    """Encode every whole text, add ``end_id`` and write the files below ``path``
    in ascending id order (NULL ids first; rows of one id by their text).

    NULL and empty texts hold the end id alone.  Repeated rows are all written.
    An empty table gives files without rows."""
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "part", "offset", "n_tokens", "tokens"]

    def run(batches):
        encode, before, part = id_encoder(tokenizer).encode, 0, TaskContext.get().partitionId()
        for rows in (x for batch in batches for x in slices(batch, 1)):
            ids, sizes = encode(pa.compute.fill_null(rows.column(1), b"").cast(pa.string()), end_id)
            ends = np.cumsum(sizes)
            tokens = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.full(len(sizes), part), pa.int32()),
                 pa.array(before + ends - sizes), pa.array(sizes), tokens], names)
            before += int(ends[-1])

    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col), text.cast("binary").alias("_text"), F.xxhash64(text).alias("_tie"))
    order = [F.col(id_col).asc_nulls_first(), F.col("_tie"), F.col("_text").asc_nulls_first()]
    rows = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select(id_col, "_text")
    (rows.mapInArrow(run, f"{id_col} {kind}, part int, offset bigint, n_tokens bigint, tokens array<int>")
     .write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.enable.dictionary", "true").option("parquet.block.size", row_group_bytes)
     .option("parquet.page.size", page_bytes).parquet(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """All columns; selecting some, or filtering on the id, reads only those
    columns and pages."""
    return spark.read.parquet(path)


def read_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, first): ids of all parts before each, from the metadata columns.
    One row per written range, so the ordered sum runs over few rows."""
    sizes = (read_tokens(spark, path).groupBy("part")
             .agg(F.max(F.col("offset") + F.col("n_tokens")).alias("size")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))


def token_digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per written row, from the files: id, start (ids of all rows
    before), n_tokens, ids_crc32 (of the ids as unsigned little-endian 32-bit)."""
    files = read_tokens(spark, path).select(id_col, "part", "offset", "tokens")
    names = [id_col, "part", "offset", "n_tokens", "ids_crc32"]

    def run(batches):
        for batch in batches:
            column = batch.column(3)
            raw = column.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            ends = column.offsets.to_numpy().astype(np.int64)
            ends = (ends - ends[0]).tolist()
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], names)

    kind = files.schema[id_col].dataType.simpleString()
    rows = files.mapInArrow(run, f"{id_col} {kind}, part int, offset bigint, n_tokens bigint, ids_crc32 bigint")
    # one row per written range: bounded by the number of write tasks
    return (rows.join(F.broadcast(read_starts(spark, path)), "part")
            .select(id_col, (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"))

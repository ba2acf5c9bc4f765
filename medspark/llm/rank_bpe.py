"""Byte-level BPE by a file of ranks, with the tiktoken library.

A text is cut at safe boundaries, places that no match of the pre-splitting
pattern crosses and from which matching starts afresh whatever stands before.
So pieces can be encoded one by one, and frequent ones are kept.  Boundaries are
all places between a character that isn't white space and one that is; in long
runs without white space also those between an ASCII letter or digit and an ASCII
character of another kind, and before ideographic punctuation.  All hold in every
version of Unicode.  What has no such place is, but for rare mixtures, one match,
which the library merges in time n log n.

Long runs of white space would overflow the library's pattern matcher.  All of a
run but the character before the next word is one match by the pattern, so it is
merged as such, without the pattern.

Decoding joins the bytes of the ids; they need not be UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medspark.llm.texts import Recent, map_texts

LONG = 1 << 14  # characters; longer pieces are cut further and not kept
ENTRIES = 200_000  # pieces that one Python worker keeps, twice at most
# The code points with the property White_Space.
_WHITE = re.escape("".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
                                     0x205F, 0x3000])))
_PIECE = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_RUN = re.compile(f"[{_WHITE}]*")
_INNER = re.compile(r"(?<=[A-Za-z])(?=[!-@\[-`{-~])|(?<=[0-9])(?=[!-/:-~])"
                    r"|(?<=[ぁ-ゖァ-ヺ一-龥가-힣])(?=[、。！，？])")


def pieces(text: str) -> list[str]:
    """``text`` cut between all neighbours of which only the second is white space."""
    return _PIECE.findall(text)


def parts_of(piece: str) -> Iterator[str]:
    """A long run without white space, cut at some safe places about ``LONG`` apart."""
    first = 0
    while (at := _INNER.search(piece, first + LONG)) is not None:
        yield piece[first:at.start()]
        first = at.start()
    yield piece[first:]


class RankEncoder:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._tiktoken = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._known = Recent(self._entry, ENTRIES)

    def _ids(self, piece: str) -> list[int]:
        white = _RUN.match(piece).end()
        if len(piece) <= LONG:
            return self._tiktoken.encode_ordinary(piece)
        # all white space is one match, or all but the last before a word
        alone = white if white == len(piece) else max(white - 1, 0)
        ids = self._tiktoken._encode_single_piece(piece[:alone].encode()) if alone else []
        for part in parts_of(piece[alone:]) if alone < len(piece) else ():
            ids = ids + self._tiktoken.encode_ordinary(part)
        return ids

    def _entry(self, piece: str) -> tuple[int, bytes, bytes]:
        """Number of ids, the ids in decimals, the bytes that they decode to."""
        ids = self._ids(piece)
        return len(ids), " ".join(map(str, ids)).encode(), self.decode(ids)

    def entries(self, text: str) -> list[tuple[int, bytes, bytes]]:
        cut = pieces(text)
        if len(text) <= LONG or max(map(len, cut)) <= LONG:
            return list(map(self._known.__getitem__, cut))
        return [self._known[p] if len(p) <= LONG else self._entry(p) for p in cut]

    def encode(self, text: str) -> list[int]:
        return [i for piece in pieces(text) for i in self._ids(piece)]

    def decode(self, ids: list[int]) -> bytes:
        return self._tiktoken.decode_bytes(ids)


_ENCODERS: dict[tuple[str, str], RankEncoder] = {}


def encoder(path: str, pattern: str) -> RankEncoder:
    """One per Python worker: workers serve many tasks."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = RankEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode_decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per input row: number of ids, digest of the ids (decimals joined by
    one space) and of the bytes that they decode to.

    NULL and empty texts have no ids and decode to nothing; repeated rows and NULL
    ids each keep their row; an empty table gives none; other columns aren't read."""
    def make():
        ranks = encoder(path, pattern)

        def columns(texts):
            counts, ids, decoded = [], [], []
            for text in texts:
                found = ranks.entries(text.decode())
                counts.append(sum([e[0] for e in found]))
                ids.append(hashlib.sha256(b" ".join([e[1] for e in found])).hexdigest())
                decoded.append(hashlib.sha256(b"".join([e[2] for e in found])).hexdigest())
            return [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
        return columns

    return map_texts(df, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", id_col, text_col)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and the text's ``ids``; NULL and empty texts
    have an empty list."""
    def make():
        ranks = encoder(path, pattern)

        def columns(texts):
            return [pa.array([ranks.encode(t.decode()) for t in texts], pa.list_(pa.int32()))]
        return columns

    return map_texts(df, make, "ids array<int>", id_col, text_col)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: the id and ``raw``, the bytes of the ids; a NULL list
    decodes to NULL, a NULL id in a list to nothing.  Ids without a rank are an error."""
    def run(batches):
        ranks = encoder(path, pattern)
        for batch in batches:
            raw = [None if ids is None else ranks.decode([i for i in ids if i is not None])
                   for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], [id_col, "raw"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(ids_col).cast("array<int>")).mapInArrow(run, f"{id_col} {kind}, raw binary")

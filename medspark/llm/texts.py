"""Words and 64-bit hashes of texts, many documents at a time.

Words are maximal runs without ASCII white space, which is what
``bytes.split()`` yields for UTF-8 texts; ``bytes.lower()`` lowers A-Z only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20  # texts hashed together; a longer text makes its own chunk
SLICE_BYTES = 2 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15  # odd, 5 mod 8: its powers have full period
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 4096)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK_BYTES:
            _POWERS[base] = have
    return have[:n]


def word_hashes(texts: list[bytes], lower: bool, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and how many each text has.
    ``gaps`` says of each byte whether it parts words; the line feed does."""
    raw = b"\n".join(texts)
    if not raw:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    data = np.frombuffer(raw, np.uint8)
    if lower:
        data = _LOWER[data]
    gap = gaps[data]
    edge = np.diff(np.concatenate(([True], gap, [True])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    values = _BYTE[data]
    values *= _powers(_BASE, len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values, out=total[1:])
    hashes = _mix((total[end] - total[start]) * _powers(_INVERSE, len(data))[start]
                  + (end - start).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.concatenate(([0], np.searchsorted(start, ends))))


def joined(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` successive word hashes (by doubling)."""
    runs, have, parts = hashes, 1, []
    rest = width
    while rest:
        if rest & 1:
            parts.append((have, runs))
        rest >>= 1
        if rest:
            n = max(len(runs) - have, 0)
            runs = _mix(runs[:n] * np.uint64(_BASE) + runs[have:have + n])
            have *= 2
    n = max(len(hashes) - width + 1, 0)
    out, at = None, 0
    for size, runs in parts:
        piece = runs[at:at + n]
        out = piece if out is None else _mix(out * np.uint64(_BASE) + piece)
        at += size
    return out


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``CHUNK_BYTES`` together."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHUNK_BYTES:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def hashed_texts(texts: list[bytes], lower: bool) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order."""
    for i, j in chunks(texts):
        hashes, counts = word_hashes(texts[i:j], lower)
        at = 0
        for n in counts.tolist():
            yield hashes[at:at + n]
            at += n


class Recent(dict):
    """Results of ``make`` by key; keeps those used lately, twice ``size`` at most."""

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self._make, self._size, self._older = make, size, {}

    def __missing__(self, key):
        value = self._older.get(key)
        if value is None:
            value = self._make(key)
        return self.put(key, value)

    def put(self, key, value):
        if len(self) >= self._size:
            self._older = dict(self)
            self.clear()
        self[key] = value
        return value


def bytes_of(column: pa.Array) -> list[bytes]:
    """A binary column with NULL as the empty text."""
    return [x or b"" for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``SLICE_BYTES`` of its text column ``text``, so
    that what is made from a part stays small."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(
        zero_copy_only=False)
    part = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def map_texts(df: DataFrame, make: Callable, schema: str, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """``make()`` once per task gives a function of the texts of a batch (UTF-8)
    that returns the columns after the id; the id passes through."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        columns_of = make()
        for batch in batches:
            for part in slices(batch, 1):
                columns = columns_of(bytes_of(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[c if isinstance(c, pa.Array) else pa.array(c) for c in columns]],
                    [id_col, *names])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col), F.col(text_col).cast("string").cast("binary"))
    return rows.mapInArrow(run, f"{id_col} {kind}, {schema}")


def map_rows(df: DataFrame, change: Callable, text_col: str) -> DataFrame:
    """``df`` with every batch passed through ``change(batch, place of the text)``,
    which keeps its columns.  They go by place, so their names don't matter."""
    names, place = df.columns, df.columns.index(text_col)
    numbered = df.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, place):
                yield change(part, place)

    return numbered.mapInArrow(run, numbered.schema).toDF(*names)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

"""Blocks of documents that ask about keys and get answers.

Statistics over all n-grams of a corpus are too many to ship one row each.  So
documents are packed into blocks of bounded size (written once); every block
dedupes its keys, deals them by hash into buckets and sends each bucket one
packed request; a bucket, holding all blocks' requests for its keys, answers each
of them; the answers meet the block again.  A key goes out once per block however
often it occurs, so no bucket is hot.  An answer is aligned with its request and
need not repeat the keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from medspark.llm.storage import written
from medspark.llm.texts import bytes_of

BLOCK_BYTES = 12 << 20  # of texts; a longer text makes its own block
BUCKET_BYTES = 8 << 20  # of all texts for each bucket of keys
REQUEST = "bucket bigint, block bigint, kind int, body binary"
ANSWER = "block bigint, bucket bigint, kind int, body binary"
_ZSTD = pa.ipc.IpcWriteOptions(compression="zstd")


def packed(columns: dict) -> bytes:
    batch = pa.record_batch({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_ZSTD) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(body: bytes) -> dict[str, np.ndarray]:
    batch = pa.ipc.open_stream(body).read_all()
    return {k: batch.column(k).to_numpy() for k in batch.column_names}


def write_blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, bytes, body): ids and texts of neighbouring rows, written once so
    that every later pass sees the same blocks."""
    def run(batches):
        base, number, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def block():
            table = pa.Table.from_batches(held).combine_chunks()
            return pa.RecordBatch.from_pydict({
                "block": pa.array([base + number], pa.int64()), "bytes": pa.array([size], pa.int64()),
                "body": pa.array([packed({k: pa.concat_arrays(table.column(k).chunks)
                                          for k in ("id", "text")})], pa.binary())})

        for batch in batches:
            batch = batch.rename_columns(["id", "text"])
            sizes = np.fromiter((len(t) + 16 for t in bytes_of(batch.column(1))), np.int64, batch.num_rows)
            first = 0
            for i, more in enumerate(sizes.tolist()):
                if size and size + more > BLOCK_BYTES:
                    if i > first:
                        held.append(batch.slice(first, i - first))
                    yield block()
                    first, number, held, size = i, number + 1, [], 0
                size += more
            if batch.num_rows > first:
                held.append(batch.slice(first))
        if held:
            yield block()

    rows = df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string").cast("binary"))
    return written(rows.mapInArrow(run, "block bigint, bytes bigint, body binary"), "blocks")


def block_rows(body: bytes) -> tuple[list[int | None], list[bytes]]:
    batch = pa.ipc.open_stream(body).read_all().combine_chunks()
    return batch.column("id").to_pylist(), [t or b"" for t in batch.column("text").to_pylist()]


def n_buckets(blocks: DataFrame) -> int:
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    return max(16, -(-total // BUCKET_BYTES))


def dealt(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its keys in ``keys``) of each bucket that has some; a
    bucket is a range of the key's upper bits, so sorted keys stay sorted."""
    if not len(keys):
        return
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    for b, places in zip(found.tolist(), np.split(order, first[1:]), strict=True):
        yield b, places


def requests_of(blocks: DataFrame, ask: Callable) -> DataFrame:
    """``ask(body)`` yields (bucket, kind, columns) for a block."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column(0)[i].as_py()
                for bucket, kind, columns in ask(batch.column(1)[i].as_py()):
                    yield request(bucket, block, kind, columns)

    return blocks.select("block", "body").mapInArrow(run, REQUEST)


def request(bucket: int, block: int, kind: int, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "bucket": pa.array([bucket], pa.int64()), "block": pa.array([block], pa.int64()),
        "kind": pa.array([kind], pa.int32()), "body": pa.array([packed(columns)], pa.binary())})


def answers_to(requests: DataFrame, answer: Callable) -> DataFrame:
    """``answer(kind, bodies)`` gives, for all requests of a bucket of one kind,
    the columns of each one's answer, in the same order."""
    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        order = np.argsort(table.column("block").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        bodies = [unpacked(b) for b in table.column("body").to_pylist()]
        replies = [packed(c) for c in answer(kind, bodies)]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"),
                         "kind": table.column("kind"), "body": pa.array(replies, pa.binary())})

    return requests.groupBy("bucket", "kind").applyInArrow(run, ANSWER)


def meet(blocks: DataFrame, answers: DataFrame, use: Callable, schema: str) -> DataFrame:
    """``use(block, body, replies)`` yields record batches for a block;
    ``replies[kind, bucket]`` are the answers' columns."""
    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        replies = {(kind, bucket): unpacked(body) for kind, bucket, body in zip(
            *(right.column(c).to_pylist() for c in ("kind", "bucket", "body")), strict=True)}
        batches = []
        for block, body in zip(*(left.column(c).to_pylist() for c in ("block", "body")), strict=True):
            batches += use(block, body, replies)
        return pa.Table.from_batches(batches) if batches else empty

    return (blocks.select("block", "body").groupBy("block")
            .cogroup(answers.groupBy("block")).applyInArrow(run, schema))

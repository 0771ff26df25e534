"""Chunks of rows and their messages to buckets: packed arrays instead of a row for each word or shingle."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MESSAGE = "bucket int, chunk long, payload binary"


def emit(rows) -> pa.RecordBatch:
    """(bucket, chunk, payload) rows as a batch."""
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "chunk", "payload"])


def chunks(batches, limit: int, rows: int = 1 << 15) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(chunk, its rows) of about ``limit`` bytes of text and at most so many rows.

    Columns: number of the partition, others, text.  The chunk of a row depends only on the
    rows before it in its partition, so a second pass over the same partitions finds the same chunks.
    """
    held, size, count, number, part = [], 0, 0, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        part, own = batch.column(0)[0].as_py(), batch.select(range(1, batch.num_columns))
        sizes, at = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy().astype(np.int64), 0
        while at < len(sizes):
            total = size + np.cumsum(sizes[at : at + rows - count])
            to = at + min(len(total), int(np.searchsorted(total, limit)) + 1)
            held.append(own.slice(at, to - at))
            size, count, at = int(total[to - at - 1]), count + to - at, to
            if size >= limit or count >= rows:
                yield (part << 32) + number, _joined(held)
                held, size, count, number = [], 0, 0, number + 1
    if held:
        yield (part << 32) + number, _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.RecordBatch.from_arrays([pa.concat_arrays([h.column(i) for h in held]) for i in range(held[0].num_columns)], schema=held[0].schema)


def trim() -> None:
    """Gives freed memory back to the system where the C library can, as workers stay alive between tasks."""
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


def to_tasks(messages: DataFrame, tasks: int) -> DataFrame:
    """Messages dealt so that each of so many tasks gets its buckets one after the other."""
    return messages.repartitionById(tasks, F.pmod("bucket", F.lit(tasks))).sortWithinPartitions("bucket", "chunk")


def packed(rows: pa.RecordBatch) -> bytes:
    """Rows as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as writer:
        writer.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def in_order(batches, by: int = 0) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(bucket, its (chunk, payload)), one after the other, of a partition sorted by bucket; by=1: (chunk, its (bucket, payload)), sorted by chunk."""
    now, held = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(3)]
        for key, other, x in zip(columns[by], columns[1 - by], columns[2], strict=True):
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append((other, x))
    if held:
        yield now, held


def by_chunk(batches) -> Iterator[tuple[int, dict[int, bytes]]]:
    """(chunk, payload by bucket) of a partition sorted by chunk."""
    for chunk, some in in_order(batches, by=1):
        yield chunk, dict(some)

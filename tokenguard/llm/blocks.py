"""Blocks: documents that lie together in a file, worked on together, with the block's different keys beside them.

A key that a third of all documents hold is one row for each block that asks about it, not one for each document. Keys meet
in ordinary aggregations and joins; what they are worth goes back to their block as rows (block, ...), and each block's
documents are summed up there."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tokenguard.llm.common import bounded_batches, slices
from tokenguard.sources.shared import new_folder

BLOCK_BYTES = 8 << 20
IN_TASK = 15  # bits of a block's number within its task
SLICE_BYTES = 1 << 20


def squeezed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unsqueezed(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_next_batch()


class Squeezing:
    """Batches squeezed one after the other as they come, none of them kept."""

    def __init__(self) -> None:
        self.sink, self.writer = pa.BufferOutputStream(), None

    def add(self, batch: pa.RecordBatch) -> None:
        self.writer = self.writer or pa.ipc.new_stream(self.sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
        self.writer.write_batch(batch)

    def done(self) -> pa.Buffer:
        self.writer.close()
        return self.sink.getvalue()


def unsqueezed_each(raw: bytes | pa.Buffer) -> Iterator[pa.RecordBatch]:
    yield from pa.ipc.open_stream(raw)


def blocks_of(docs: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], pa.RecordBatch], schema: str, owner: str, times: float = 1) -> DataFrame:
    """(block, what make returns as one row) for blocks of `times` BLOCK_BYTES of text, written to the shared folder. make gets the
    slices of a block; docs has a column text. owner: as in slices."""
    bounded_batches(docs.sparkSession)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, block = slices(batches, "text", SLICE_BYTES, owner), TaskContext.get().partitionId() << IN_TASK

        def one(first: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            size = first.column(text).nbytes
            yield first
            while size < times * BLOCK_BYTES:
                if (part := next(parts, None)) is None:
                    return
                size += part.column(text).nbytes
                yield part

        while (first := next(parts, None)) is not None:
            made = make(one(first))
            yield pa.RecordBatch.from_arrays([pa.array([block]), *made.columns], ["block", *made.schema.names])
            block += 1

    path = new_folder(docs.sparkSession)
    made = docs.mapInArrow(run, f"block long, {schema}")
    made.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)

"""Texts packed in groups, so that what a group asks elsewhere can be answered in the order of its asking."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tesselon.llm._shared import store
from tesselon.llm._text import slices, utf8

_SCHEMA = "grp long, bytes long, packed binary"


def _packer(group_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial, kept, amount = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                for part in kept:
                    writer.write_batch(part)
            columns = [pa.array([task << 32 | serial], pa.int64()), pa.array([amount], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["grp", "bytes", "packed"])

        for batch in slices(batches, "text"):
            kept.append(batch)
            amount += len(utf8(batch.column(batch.schema.get_field_index("text")))[1])
            if amount >= group_bytes:
                yield flush()
                kept, amount, serial = [], 0, serial + 1
        if kept:
            yield flush()

    return run


def pack(rows: DataFrame, group_bytes: int) -> DataFrame:
    """(grp, bytes, packed): the rows, which have a column text, in groups of some ``group_bytes`` of text. The
    table is stored: which rows meet in a group must not change between what reads it."""
    return store(rows.mapInArrow(_packer(group_bytes), _SCHEMA))


def unpack(blob: pa.BinaryScalar) -> pa.RecordBatch:
    """The rows of a group."""
    return pa.ipc.open_stream(blob.as_buffer()).read_all().combine_chunks().to_batches()[0]

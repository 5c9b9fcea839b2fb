"""Documents in chunks of some megabytes, as a bucketed table that answers can be joined to without moving it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidewire.llm.common import by_bytes, chunked, scratch_path, text_buffers

#: Bytes of text in a chunk (a longer text is a chunk of its own), and of input files for a bucket of chunks.
CHUNK, BUCKET = 2 << 20, 32 << 20
#: Stands for a null doc_id; above all others.
NO_ID = np.iinfo(np.int64).max


def _pack(most: int):
    """Rows (doc_id, text, flag) to chunks; a chunk's number is the task's partition and a count, the same if the task runs again."""

    def chunk(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        raw, offsets = text_buffers(t["text"].combine_chunks())
        ids = t["doc_id"].combine_chunks()
        parts = [np.asarray(ids.fill_null(NO_ID), np.int64), np.asarray(ids.is_null()).astype(np.int8), np.asarray(t["flag"].combine_chunks()).astype(np.int8), offsets, raw]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (number, len(raw), *[np.ascontiguousarray(p).tobytes() for p in parts])], ["chunk_id", "size", "docs", "nulls", "flags", "offsets", "raw"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in chunked(batches, "text", most):
            more = batch.column(1).nbytes
            if held and size + more > most:
                yield chunk(number, held)
                number, held, size = number + 1, [], 0
            held.append(batch)
            size += more
        if held:
            yield chunk(number, held)

    return run


def chunk_table(rows: DataFrame, size: int, most: int = CHUNK) -> DataFrame:
    """The chunks of rows (doc_id long, text string, flag boolean), none of them null but doc_id, bucketed by chunk_id.

    size: bytes of the files that the rows come from. The number of buckets follows it, so that what a task joins to its
    bucket stays of one size whatever the input's.
    """
    spark = rows.sparkSession
    name = f"tidewire_chunks_{uuid.uuid4().hex}"
    path = scratch_path(spark, "chunks", name)
    buckets = by_bytes(size, BUCKET, int(spark.conf.get("spark.sql.shuffle.partitions")))
    writer = rows.select("doc_id", "text", "flag").mapInArrow(_pack(most), "chunk_id long, size long, docs binary, nulls binary, flags binary, offsets binary, raw binary").write
    writer.option("path", path).option("compression", "zstd").option("parquet.block.size", str(16 << 20)).bucketBy(buckets, "chunk_id").saveAsTable(name)
    return spark.table(name)


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, offsets, bytes) of a chunk."""
    return np.frombuffer(row["docs"], np.int64), np.frombuffer(row["offsets"], np.int64), np.frombuffer(row["raw"], np.uint8)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables of the rows that share a value, from rows sorted by that column of integers."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.asarray(batch.column(batch.schema.get_field_index(column)), np.int64)
        if held and held[-1].column(column)[-1].as_py() != at[0]:
            yield pa.Table.from_batches(held)
            held = []
        edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        for a, b in zip(edges, edges[1:], strict=False):
            held.append(batch.slice(a, b - a))
            if b < len(at):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)

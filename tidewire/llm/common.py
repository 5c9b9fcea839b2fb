"""Shared helpers: table reading, staged tables in the shared folder, word rules, Arrow plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs of other characters than these (space, tab, line feed, vertical tab, form feed, return).
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a folder of our own only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tidewire-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Intermediate tables of this process that still stand: (session, path, catalog name or None).
_scratch: list[tuple[SparkSession, str, str | None]] = []


def scratch_path(spark: SparkSession, name: str, table: str | None = None) -> str:
    """A new path in the shared folder, which `discard` or else the JVM's end deletes."""
    path = f"{shared_dir(spark)}/tidewire/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path, table))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def mark() -> int:
    """How many intermediate tables there are; `discard` takes it."""
    return len(_scratch)


def discard(since: int = 0, until: int | None = None) -> None:
    """Delete the intermediate tables from number `since` on. Results that were not written yet may still read them."""
    for spark, path, name in _scratch[since:until]:
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del _scratch[since:until]


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    return spark.read.schema(nullable).parquet(path)


def plan_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of df's files as the optimizer knows them; of one column's values, by a pass over it, where it doesn't."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else df.agg(F.sum(F.octet_length(F.col(column).cast("string")))).first()[0] or 0


def by_bytes(size: int, each: int, least: int = 1, most: int = 100_000) -> int:
    """Parts of about `each` bytes; `most` is the largest number of buckets that Spark allows."""
    return max(least, min(-(-size // each), most))


def whole_ids(df: DataFrame, column: str = "doc_id") -> DataFrame:
    """df, whose ids have to be whole numbers: others would become null or wrong when they are packed as 64 bits."""
    if not isinstance(df.schema[column].dataType, T.IntegralType):
        raise TypeError(f"{column} is {df.schema[column].dataType.simpleString()}; whole numbers are needed")
    return df


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows (one more than rows); nulls are empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = pa.compute.fill_null(column, b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def chunked(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one hold about most_bytes at the most; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0), np.int64)
        ends, first = np.cumsum(sizes), 0
        while first < batch.num_rows:
            base = ends[first - 1] if first else 0
            last = min(max(first + 1, int(np.searchsorted(ends, base + most_bytes, side="right"))), first + most_rows)
            yield batch.slice(first, last - first)
            first = last


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes: the group of each element and its place there."""
    group = np.repeat(np.arange(len(counts)), counts)
    start = np.cumsum(counts) - counts
    return group, np.arange(len(group)) - np.repeat(start, counts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters its input (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def bounded_batches(spark: SparkSession, rows: int = 2048, size: str = "8m") -> None:
    """Bound the Arrow batches of this session, so that a batch of long texts or large blobs fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)

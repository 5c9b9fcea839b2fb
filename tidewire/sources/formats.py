"""Spark readers and writers of frame files.

`frames` is a Python data source over files of frames, in batch and as a stream of files; `read_frames` is its
DataFrame form over Spark's own binary reader, which reaches any file system that Spark does. Frames are written by
`write_frames` through Spark's writers, one binary row per coalesced write.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from tidewire.sources import cluster
from tidewire.sources.framing import FrameError, FrameReader, coalesced, decode_envelope, encode_envelope

SCHEMA = "path string, n long, kind string, topic string, source string, token string, data binary, error string"


def cut(raw: bytes, most: int) -> tuple[list[bytes], str | None]:
    """The frames of a file, and what ends it before its end."""
    reader, payloads = FrameReader(most), []
    try:
        payloads = reader.feed(raw)
        reader.feed(b"")  # raises if a broken length follows
    except FrameError as e:
        return payloads, str(e)
    return payloads, "cut frame" if reader.rest else None


def decoded(path: str, raw: bytes, most: int) -> Iterator[tuple]:
    """Rows of one file's frames; a broken length ends the file with an error row, a broken envelope gives one and goes on."""
    payloads, broken = cut(raw, most)
    n = 0
    for n, payload in enumerate(payloads, 1):
        try:
            m = decode_envelope(payload, most)
            yield path, n, m["kind"], m.get("topic", ""), m.get("source", ""), m.get("token", ""), m.get("data", b""), None
        except FrameError as e:
            yield path, n, None, None, None, None, None, str(e)
    if broken:
        yield path, n + 1, None, None, None, None, None, broken


def read_frames(spark: SparkSession, path: str, most: int = 1 << 20) -> DataFrame:
    """Frames of all files at path; each file is read by one task, as frames can't be found from its middle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(decoded(p, raw, most))
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def encoded(messages: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Adds `frame`: the envelope of (kind, topic, source, token, data); null where it is larger than `most`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.select(["kind", "topic", "source", "token", "data"]).to_pylist():
                try:
                    out.append(encode_envelope(row, most))
                except FrameError:
                    out.append(None)
            yield batch.append_column("frame", pa.array(out, pa.binary()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema.fields)
    return messages.mapInArrow(run, f"{fields}, frame binary")


def write_frames(messages: DataFrame, path: str, most: int = 1 << 20, together: int = 64) -> None:
    """Write messages as coalesced binary rows, the order within a partition being kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        payloads = (x for batch in batches for x in batch.column(batch.schema.get_field_index("frame")).to_pylist() if x is not None)
        for raw in coalesced(payloads, together):
            yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["raw"])

    encoded(messages, most).select("frame").mapInArrow(run, "raw binary").write.mode("overwrite").parquet(path)


def read_written(spark: SparkSession, path: str, most: int = 1 << 20) -> DataFrame:
    """Messages that write_frames wrote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for raw in batch.column(0).to_pylist() for r in decoded("", raw, most)]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    return spark.read.schema("raw binary").parquet(path).mapInArrow(run, SCHEMA).drop("path")


_TYPES = {"s": "string", "b": "binary", "i": "long", "e": "string", "S": "array<string>"}


def _type(kind: str) -> str:
    """The type of a field of the cluster plane; lists of messages are arrays of structs."""
    if kind in _TYPES:
        return _TYPES[kind]
    inner = ", ".join(f"{name}: {_type(k)}" for name, k in (x.split(":") for x in cluster.MESSAGES[kind].split()))
    return f"array<struct<{inner}>>"


#: Every field of every arm of the cluster plane; fields of one name have one type.
CLUSTER_FIELDS = {name: _type(kind) for arm in cluster.ARMS for name, kind in (x.split(":") for x in cluster.MESSAGES[arm].split())}


def decode_cluster(frames: DataFrame, most: int | None = None) -> DataFrame:
    """Envelopes in `frame` decoded: kind ("" if unknown), the fields of all arms, of which a row has those of its arm, and error.

    Other columns are kept. A broken envelope, one over `most` bytes, or null gives a row with an error.
    """
    kept = [c for c in frames.columns if c != "frame"]
    types = [f"`{c}` {frames.schema[c].dataType.simpleString()}" for c in kept]
    full = ", ".join([*types, "kind string", *(f"{n} {t}" for n, t in CLUSTER_FIELDS.items()), "error string"])
    schema = to_arrow_schema(T.StructType.fromDDL(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(batch.schema.get_field_index("frame")).to_pylist():
                try:
                    rows.append(cluster.decode_envelope(raw, most) if raw is not None else {"error": "null"})
                except FrameError as e:
                    rows.append({"error": str(e)})
            old = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            new = [pa.array([r.get(f.name) for r in rows], f.type) for f in list(schema)[len(kept) :]]
            yield pa.RecordBatch.from_arrays([*old, *new], schema=schema)

    return frames.select(*kept, "frame").mapInArrow(run, full)


def encode_cluster(messages: DataFrame, most: int | None = None) -> DataFrame:
    """Adds `frame`: the envelope of kind and the fields of its arm, of which absent ones are empty; null where it is larger than `most` or of no known kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    out.append(cluster.encode_envelope(row, most) if row["kind"] in cluster.ARMS else None)
                except FrameError:
                    out.append(None)
            yield batch.append_column("frame", pa.array(out, pa.binary()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema.fields)
    return messages.mapInArrow(run, f"{fields}, frame binary")


def read_links(spark: SparkSession, path: str, most: int = 1 << 20) -> DataFrame:
    """The second source: cluster frames of all files at path, one file per link and task, decoded; a broken length ends its file with an error row."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payloads, broken = cut(raw, most)
                payloads = [*payloads, *[None] * bool(broken)]  # a null frame is an error row
                n = len(payloads)
                yield pa.RecordBatch.from_arrays([pa.array([p] * n, pa.string()), pa.array(range(1, n + 1), pa.int64()), pa.array(payloads, pa.binary())], ["path", "n", "frame"])

    return decode_cluster(spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(split, "path string, n long, frame binary"), most)


class _Written(WriterCommitMessage):
    def __init__(self, path: str | None) -> None:
        self.path = path


class FrameWriterStream(DataSourceStreamWriter):
    """Each task of a micro-batch writes the frames of its rows, coalesced, to a hidden file; the commit gives the files their names.

    A batch that is committed again replaces its files, so readers see each frame once.
    """

    def __init__(self, options: dict) -> None:
        self.folder, self.most, self.together = options["path"], int(options.get("maxFrame", 1 << 20)), int(options.get("coalesced", 64))

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        path, some = os.path.join(self.folder, f".{uuid.uuid4().hex}"), False
        os.makedirs(self.folder, exist_ok=True)
        with open(path, "wb") as f:
            for raw in coalesced((encode_envelope(row.asDict(), self.most) for row in iterator), self.together):
                f.write(raw)
                some = True
        if not some:
            os.remove(path)
        return _Written(path if some else None)

    def commit(self, messages: list, batchId: int) -> None:
        for i, m in enumerate(messages):
            if m is not None and m.path:
                os.replace(m.path, os.path.join(self.folder, f"batch-{batchId:012d}-{i:05d}.bin"))

    def abort(self, messages: list, batchId: int) -> None:
        for m in messages:
            if m is not None and m.path and os.path.exists(m.path):
                os.remove(m.path)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def _files(folder: str) -> list[str]:
    return sorted(os.path.join(folder, x) for x in os.listdir(folder) if not x.startswith((".", "_")))


class FrameReaderBatch(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.most = options["path"], int(options.get("maxFrame", 1 << 20))

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in _files(self.folder)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            yield from decoded(partition.path, f.read(), self.most)


def _arrived(folder: str) -> list[tuple[int, str]]:
    """(time of change in nanoseconds, path) of the folder's files, in that order."""
    return sorted((os.stat(p).st_mtime_ns, p) for p in _files(folder))


class FrameReaderStream(DataSourceStreamReader):
    """Files in the order of their change, one task each; the offset is the last one's time and path.

    A file that comes later sorts after those that were read, whatever its name; files are moved into the folder when
    they are complete, by the clock of one file system.
    """

    def __init__(self, options: dict) -> None:
        self.folder, self.most = options["path"], int(options.get("maxFrame", 1 << 20))

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = _arrived(self.folder)
        return {"changed": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = (start["changed"], start["path"]), (end["changed"], end["path"])
        return [_File(p) for at, p in _arrived(self.folder) if first < (at, p) <= last]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            yield from decoded(partition.path, f.read(), self.most)


class FrameSource(DataSource):
    """spark.read, spark.readStream and writeStream.format("frames") over a folder that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FrameReaderBatch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FrameReaderStream(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return FrameWriterStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSource)


def topics_of(frames: DataFrame) -> DataFrame:
    """Frames without errors, with normalized topics."""
    from tidewire.functions.columns import normalize_topic

    return frames.where(F.col("error").isNull()).withColumn("topic_raw", F.col("topic")).withColumn("topic", normalize_topic(F.col("topic")))

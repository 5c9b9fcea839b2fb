"""Structured Streaming forms of the operators.

Stateless operators work on streams as they are. The ordered folds run in `transformWithStateInPandas` with the same
step functions as in batch; events of a micro-batch are folded in the order of `arrival`.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewire.operators.folds import Step

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FoldProcessor(StatefulProcessor):
    """One fold per key; its state is one value that lives as long as the key, or ttl_ms after the last event."""

    def __init__(self, step: Step, keys: list[str], columns: list[str], order: tuple[str, ...], ttl_ms: int | None) -> None:
        self.step, self.keys, self.columns, self.order, self.ttl_ms = step, keys, columns, order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", "state binary", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else {}
        events = pd.concat(list(rows)).sort_values(list(self.order), kind="stable").to_dict("records")
        out = [r for e in events for r in self.step(held, e)]
        self.state.update((pickle.dumps(held),))
        frame = pd.DataFrame(out, columns=self.columns, dtype=object)
        for i, k in enumerate(self.keys):
            frame.insert(i, k, key[i])
        yield frame

    def close(self) -> None:
        pass


def stream_fold(df: DataFrame, keys: list[str], step: Step, schema: str, *, order: tuple[str, ...] = ("arrival",), ttl_ms: int | None = None) -> DataFrame:
    """`apply_fold` over a stream. The session needs the RocksDB state store provider."""
    columns = [c.strip().split()[0] for c in schema.split(",")]
    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    mode = "ProcessingTime" if ttl_ms else "None"
    return df.groupBy(*keys).transformWithStateInPandas(FoldProcessor(step, keys, columns, order, ttl_ms), f"{types}, {schema}", "Append", mode)


class IdleProcessor(StatefulProcessor):
    """Gives (key, since_ms, at_ms) when a key was silent for timeout_ms of event time."""

    def __init__(self, keys: list[str], at: str, timeout_ms: int) -> None:
        self.keys, self.at, self.timeout_ms = keys, at, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = max(int(pd.Timestamp(r).timestamp() * 1000) for frame in rows for r in frame[self.at])
        if self.last.exists():
            latest = max(latest, self.last.get()[0])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((latest,))
        self.handle.registerTimer(latest + self.timeout_ms)
        yield self._rows(key, [])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        since = self.last.get()[0]
        self.last.clear()
        yield self._rows(key, [(since, since + self.timeout_ms)])

    def _rows(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in rows], columns=[*self.keys, "since_ms", "at_ms"], dtype=object)

    def close(self) -> None:
        pass


def stream_idle(df: DataFrame, keys: list[str], at: str, timeout_ms: int) -> DataFrame:
    """Idle keys of a stream with a watermark on `at`: connections, links without beats, targets to expire."""
    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.groupBy(*keys).transformWithStateInPandas(IdleProcessor(keys, at, timeout_ms), f"{types}, since_ms long, at_ms long", "Append", "EventTime")


def stream_deduplicate(df: DataFrame, identity: list[str], at: str, within: str) -> DataFrame:
    """Duplicates within a time, not within a window of sequences: an approximation of the tracker fold with bounded state."""
    return df.withWatermark(at, within).dropDuplicatesWithinWatermark(identity)


def stream_rates(df: DataFrame, by: str, at: str, width: str, late: str) -> DataFrame:
    """Counts per tumbling window."""
    return df.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n"))


def deliver(stream: DataFrame, listeners: dict, checkpoint: str, query_name: str | None = None):
    """Call each topic's listener with the micro-batch rows of its topic; a topic has one listener."""

    def each(batch: DataFrame, batch_id: int) -> None:
        held = batch.where(F.col("topic").isin(*listeners)).persist()
        for topic, listener in listeners.items():
            listener(held.where(F.col("topic") == topic), batch_id)
        held.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.queryName(query_name) if query_name else writer).start()

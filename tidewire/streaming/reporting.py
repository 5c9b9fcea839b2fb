"""A listener that turns a query's progress into metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class ProgressReport(StreamingQueryListener):
    """Calls `emit` with one key=value line per progress."""

    def __init__(self, emit: Callable[[str], None]) -> None:
        self.emit = emit

    def onQueryStarted(self, event) -> None:
        self.emit(f"event=query-started id={event.id}")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.emit(f"event=progress id={p.id} batch={p.batchId} rows={p.numInputRows} rate={p.processedRowsPerSecond:.1f}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.emit(f"event=query-terminated id={event.id}")

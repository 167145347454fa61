"""Progress of streaming queries as a table."""

from __future__ import annotations

import json
import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger(__name__)

PROGRESS = (
    "query string, batch_id bigint, at string, input_rows bigint, rows_per_second double, "
    "late_rows bigint, state_rows bigint, sources string"
)


def progress_row(progress) -> tuple:
    """Late rows are those the watermark dropped. Offsets belong to a query's sources."""
    operators = progress.stateOperators
    sources = [
        {"source": s.description, "start": s.startOffset, "end": s.endOffset}
        for s in progress.sources
    ]
    return (
        progress.name or str(progress.id),
        progress.batchId,
        progress.timestamp,
        progress.numInputRows,
        float(progress.processedRowsPerSecond or 0.0),
        sum(o.numRowsDroppedByWatermark for o in operators),
        sum(o.numRowsTotal for o in operators),
        json.dumps(sources, default=str),
    )


class ProgressLog(StreamingQueryListener):
    """Keeps progress rows and appends them to a table, ``every`` rows at a time or once the oldest
    has waited ``seconds``: what a lost driver takes with it is that much at most."""

    def __init__(self, spark: SparkSession, path: str, every: int = 100, seconds: float = 60):
        self.spark, self.path, self.every, self.seconds = spark, path, every, seconds
        self.pending: list[tuple] = []
        self.since = 0.0

    def _due(self) -> bool:
        waited = time.monotonic() - self.since
        return bool(self.pending) and (len(self.pending) >= self.every or waited >= self.seconds)

    def onQueryStarted(self, event):
        log.info("query %s started", event.name or event.id)

    def onQueryProgress(self, event):
        if not self.pending:
            self.since = time.monotonic()
        self.pending.append(progress_row(event.progress))
        if self._due():
            self.flush()

    def onQueryIdle(self, event):
        if self._due():
            self.flush()

    def onQueryTerminated(self, event):
        if event.exception:
            log.error("query %s failed: %s", event.id, event.exception)
        self.flush()

    def flush(self) -> None:
        rows, self.pending = self.pending, []
        if rows:
            frame = self.spark.createDataFrame(rows, PROGRESS)
            frame.coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(PROGRESS).parquet(self.path)

"""What a stream tells of itself, as a table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .buffered import LATE, REPORT, ROW

#: A row for each micro-batch. ``late`` came as rows of their own, ``dropped`` were too late even for that.
PROGRESS = "name string, run string, batch long, watermark string, input_rows long, rows long, late long, reports long, dropped long, state_rows long, seconds double"
METRICS = "session_events"


def observed(events: DataFrame) -> DataFrame:
    """``EVENTS`` that are counted by kind as they pass."""
    return events.observe(METRICS, *(F.count_if(F.col("kind") == k).alias(n) for k, n in ((ROW, "rows"), (LATE, "late"), (REPORT, "reports"))))


class ProgressTable(StreamingQueryListener):
    """Appends ``PROGRESS`` of every stream of the session to a folder of Parquet files, a batch at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        counts = p.observedMetrics.get(METRICS)
        of = lambda name: int(getattr(counts, name)) if counts is not None else None
        states = p.stateOperators
        row = (
            p.name,
            str(p.runId),
            p.batchId,
            p.eventTime.get("watermark"),
            p.numInputRows,
            *map(of, ("rows", "late", "reports")),
            sum(s.numRowsDroppedByWatermark for s in states),
            sum(s.numRowsTotal for s in states),
            p.durationMs.get("triggerExecution", 0) / 1000,
        )
        self.spark.createDataFrame([row], PROGRESS).coalesce(1).write.mode("append").parquet(self.folder)

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        pass

"""Lag and loss of running queries."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from lanternlog.streaming.ledger import Files

PROGRESS = (
    "query string, batch bigint, reported string, rows bigint, rows_per_second double, duration_ms bigint, dropped_events bigint, "
    "consumer_lag bigint, data_loss_warning boolean"
)


def progress_metrics(progress: dict[str, Any]) -> dict[str, Any]:
    """Rates, lag and losses of one progress report."""
    dropped = sum(int(s.get("numRowsDroppedByWatermark", 0)) for s in progress.get("stateOperators", []))
    lag = 0
    for source in progress.get("sources", []):
        metrics = source.get("metrics") or {}
        behind = metrics.get("maxOffsetsBehindLatest") or metrics.get("numFilesOutstanding") or 0
        lag += int(float(behind))
    return {
        "batch": progress.get("batchId"),
        "reported": progress.get("timestamp"),
        "rows": int(progress.get("numInputRows") or 0),
        "rows_per_second": float(progress.get("processedRowsPerSecond") or 0.0),
        "duration_ms": int((progress.get("durationMs") or {}).get("triggerExecution", 0)),
        "dropped_events": dropped,
        "consumer_lag": lag,
        "data_loss_warning": dropped > 0,
    }


class MetricsListener(StreamingQueryListener):
    """Hands the metrics of every micro-batch of every query to ``report``."""

    def __init__(self, report):
        self._report = report

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self._report(str(event.progress.id), progress_metrics(json.loads(event.progress.json)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def query_metrics(query: StreamingQuery) -> list[dict[str, Any]]:
    """Metrics of the micro-batches a query still remembers."""
    return [progress_metrics(json.loads(p.json if hasattr(p, "json") else json.dumps(p))) for p in query.recentProgress]


def store_progress(spark: SparkSession, folder: str, query_id: str, metrics: dict[str, Any]) -> None:
    """Keep the report of one micro-batch as one row of the progress table; a repeated report replaces it."""
    Files(spark, folder).put(f"progress/{query_id}-{metrics['batch']}.json", {"query": query_id, **metrics}, replace=True)


def progress_table(spark: SparkSession, folder: str) -> DataFrame:
    """All stored reports."""
    if not Files(spark, folder).names("progress"):
        return spark.createDataFrame([], PROGRESS)
    return spark.read.schema(PROGRESS).json(f"{folder}/progress")


def progress_recorder(spark: SparkSession, folder: str) -> MetricsListener:
    """A listener that stores every report; add it with ``spark.streams.addListener``."""
    return MetricsListener(lambda query_id, metrics: store_progress(spark, folder, query_id, metrics))

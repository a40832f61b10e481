"""Keyed state of the detection stream: the latest buckets of every template, with an expiry timer.

Micro-batches reach the state as partial counts per task, template and bucket, so a template that makes up most of a batch is a few
rows. For each template that a batch touches, the state hands on what the spike rule needs: the touched buckets with their
counts before and after, and the buckets before them. Nothing that earlier batches wrote is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lanternlog.operators.buckets import KEY, with_bucket
from lanternlog.schemas import ERROR_LEVELS
from lanternlog.session import ship_package

#: Columns of the first observation of a template, as a new-template incident shows them.
FIRST = ("event_ts", "source_path", "line_number", "id", "source_id", "level", "sanitized_message", "sample_hash")
_FIRST_TYPES = "event_ts timestamp, source_path string, line_number bigint, id string, source_id string, level string, sanitized_message string, sample_hash string"
_KEYS = "template_id string, application string, environment string"
PARTIAL = f"{_KEYS}, bucket_start timestamp, count bigint, error_count bigint, {_FIRST_TYPES}"
#: ``before`` is null for buckets that a batch does not touch; ``first`` marks the row that carries a new template's first observation.
HISTORY = f"{_KEYS}, bucket_start timestamp, count bigint, error_count bigint, before bigint, first boolean, {_FIRST_TYPES}"
_STATE = "starts array<bigint>, counts array<bigint>, errors array<bigint>, seen bigint"


def partial_counts(observations: DataFrame, minutes: int) -> DataFrame:
    """Counts per task, template and bucket, each with the first observation among its rows."""
    ship_package(observations.sparkSession)
    names = [*KEY, "bucket_start"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def folded() -> pd.DataFrame:
            rows = pd.concat(held) if len(held) > 1 else held[0]
            held.clear()
            rows = rows.sort_values(["event_ts", "source_path", "line_number", "id"], kind="stable")
            groups = rows.groupby(names, dropna=False, sort=False)
            return groups.first().join(groups[["_n", "_bad"]].sum().rename(columns={"_n": "count", "_bad": "error_count"})).reset_index()[
                [*names, "count", "error_count", *FIRST]
            ]

        for batch in batches:
            if len(batch):
                made = batch.assign(_n=1, _bad=batch["level"].isin(ERROR_LEVELS).astype("int64"))
                held.append(made)
                if sum(map(len, held)) >= 100_000:
                    yield folded()
        if held:
            yield folded()

    return with_bucket(observations, minutes).select(*names, *FIRST).mapInPandas(work, PARTIAL)


class TemplateHistory(StatefulProcessor):
    """Latest ``baseline`` buckets of a template and those after the watermark; forgotten ``keep_ms`` after its last event."""

    def __init__(self, baseline: int, bucket_ms: int, keep_ms: int):
        self._baseline, self._bucket_ms, self._keep_ms = baseline, bucket_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("history", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        import pandas as pd

        held = self._state.get() if self._state.exists() else None
        buckets = {} if held is None else dict(zip(held[0], zip(held[1], held[2])))
        before = {start: count for start, (count, _) in buckets.items()}
        first, touched = None, set()
        for part in rows:
            part = part.sort_values(["event_ts", "source_path", "line_number", "id"], kind="stable")
            starts = part["bucket_start"].astype("datetime64[ms]").astype("int64").tolist()
            for start, count, errors in zip(starts, part["count"].tolist(), part["error_count"].tolist()):
                old = buckets.get(start, (0, 0))
                buckets[start] = (old[0] + count, old[1] + errors)
                touched.add(start)
            head = part.iloc[0]
            order = tuple(head[c] for c in ("event_ts", "source_path", "line_number", "id"))
            if first is None or order < first[0]:
                first = order, head
        if not touched:
            return
        # Buckets that may still grow, and the latest before them, are all that later batches need.
        order = sorted(buckets)
        low = order.index(min(touched))
        shown = order[max(0, low - self._baseline) :]
        out = pd.DataFrame({
            **{name: [value] * len(shown) for name, value in zip(KEY, key)},
            "bucket_start": pd.to_datetime(shown, unit="ms"),
            "count": [buckets[s][0] for s in shown],
            "error_count": [buckets[s][1] for s in shown],
            "before": pd.array([before.get(s, 0) if s in touched else None for s in shown], dtype="Int64"),
            "first": [held is None and s == min(touched) for s in shown],
            **{c: [first[1][c]] * len(shown) for c in FIRST},
        })
        watermark = timerValues.getCurrentWatermarkInMs()
        open_from = next((i for i, s in enumerate(order) if s + self._bucket_ms > watermark), len(order))
        kept = order[max(0, open_from - self._baseline) :]
        seen = max(order[-1] + self._bucket_ms, held[3] if held else 0)
        self._state.update(([*kept], [buckets[s][0] for s in kept], [buckets[s][1] for s in kept], seen))
        if held is None or held[3] != seen:
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(seen + self._keep_ms)
        yield out

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self._state.clear()
        return iter(())

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: Any) -> None:
        """Templates of earlier runs are known from the start."""
        seen = int(initialState["last_seen"].astype("datetime64[ms]").astype("int64").max())
        self._state.update(([], [], [], seen))
        self._handle.registerTimer(seen + self._keep_ms)

    def close(self) -> None:
        pass


def template_histories(
    observations: DataFrame, minutes: int, baseline: int, late_by_hours: int, keep_hours: int, known: DataFrame | None = None
) -> DataFrame:
    """Stream of HISTORY rows; ``known`` is a dictionary (id, application, environment, last_seen) of earlier runs.

    Needs the RocksDB state store.
    """
    bucket_ms = minutes * 60_000
    partial = partial_counts(observations, minutes).withWatermark("bucket_start", f"{late_by_hours} hours")
    initial = None
    if known is not None:
        initial = known.select(F.col("id").alias("template_id"), "application", "environment", "last_seen").groupBy(*KEY)
    processor = TemplateHistory(baseline, bucket_ms, keep_hours * 3_600_000)
    return partial.groupBy(*KEY).transformWithStateInPandas(processor, HISTORY, "Update", "EventTime", initial)

"""Job ``serve``: the result sets behind dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternlog.operators.buckets import recent_buckets, recent_samples
from lanternlog.operators.ranking import top_rows
from lanternlog.schemas import OPEN_STATUSES

VERDICT_COLUMNS = ("severity", "confidence", "investigate", "summary", "recommended_actions", "possible_causes")


def latest_per_key(df: DataFrame, key: str, newest: str = "created_at") -> DataFrame:
    """The newest row of each key; ties go to the larger id."""
    return top_rows(df, [key], [F.desc(newest), F.desc("id")], 1).drop("rank")


def _verdicts(analyses: DataFrame, latest_only: bool, *more: str) -> DataFrame:
    rows = latest_per_key(analyses, "anomaly_id") if latest_only else analyses
    return rows.select(
        F.col("anomaly_id").alias("_anomaly"),
        *VERDICT_COLUMNS,
        *more,
        F.col("error").alias("ai_error"),
        "is_retryable",
        F.col("created_at").alias("analyzed_at"),
    )


def active_anomalies(anomalies: DataFrame, analyses: DataFrame, latest_only: bool = False) -> DataFrame:
    """Open anomalies with their verdicts, newest first.

    An anomaly that was analysed again appears once per verdict, or once with ``latest_only``.
    """
    still_open = anomalies.where(F.col("status").isin(*OPEN_STATUSES))
    verdicts = _verdicts(analyses, latest_only)
    joined = still_open.join(verdicts, still_open["id"] == verdicts["_anomaly"], "left").drop("_anomaly")
    return joined.orderBy(F.desc("detected_at"), "id", "analyzed_at")


def dismissed_anomalies(
    anomalies: DataFrame, feedback: DataFrame, analyses: DataFrame, limit: int = 50, latest_only: bool = False
) -> DataFrame:
    """The newest dismissed anomalies with the feedback that closed them and their verdicts.

    Every anomaly keeps at least one row through the left joins, so the first ``limit`` rows come from the
    first ``limit`` anomalies and nothing else has to be joined.
    """
    newest = (
        anomalies.where(F.col("status") == "dismissed").orderBy(F.desc("detected_at"), "id").limit(limit)
    )
    actions = feedback.select(
        F.col("anomaly_id").alias("_subject"),
        F.col("comment").alias("dismissal_comment"),
        F.col("action").alias("dismissal_action"),
        F.col("created_at").alias("dismissed_at"),
    )
    verdicts = _verdicts(analyses, latest_only, "evidence")
    joined = (
        newest.join(actions, newest["id"] == actions["_subject"], "left")
        .join(verdicts, newest["id"] == verdicts["_anomaly"], "left")
        .drop("_subject", "_anomaly")
    )
    order = [F.desc("detected_at"), F.col("id"), F.col("dismissed_at"), F.col("analyzed_at")]
    return joined.orderBy(*order).limit(limit)


def template_detail(
    catalog: DataFrame, buckets: DataFrame, stored: DataFrame, history: int = 12, samples: int = 5
) -> DataFrame:
    """Templates with their newest buckets and samples as nested lists."""
    past = (
        recent_buckets(buckets, history)
        .groupBy("template_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("rank", "bucket_start", "bucket_end", "count", "error_count"))
            ).alias("history")
        )
    )
    texts = (
        recent_samples(stored, samples)
        .groupBy("template_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("rank", "sample_hash", "sanitized_message", "level", "event_ts"))
            ).alias("samples")
        )
    )
    joined = catalog.withColumnRenamed("id", "template_id")
    return joined.join(past, "template_id", "left").join(texts, "template_id", "left")


def related_anomalies(anomalies: DataFrame, keys: tuple[str, ...], limit: int = 10) -> DataFrame:
    """Per anomaly up to ``limit`` others of its batch, in order of detection.

    The first ``limit + 1`` anomalies of a batch hold the answer for all of its members, so no pairs are made.
    """
    columns = ("id", "anomaly_type", "template_text", "current_count", "source_paths", "detected_at")
    first = top_rows(
        anomalies.select(*keys, *columns), list(keys), [F.col("detected_at"), F.col("id")], limit + 1, "place"
    )
    listed = first.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("place", *columns))).alias("_first")
    )
    others = F.filter("_first", lambda other: other["id"] != F.col("id"))
    return (
        anomalies.join(listed, list(keys))
        .withColumn("related", F.slice(others, 1, limit))
        .drop("_first")
    )


def filter_incidents(
    incidents: DataFrame,
    severity: str | None = None,
    application: str | None = None,
    environment: str | None = None,
    source: str | None = None,
) -> DataFrame:
    """Incidents that match every given value."""
    for column, value in (("severity", severity), ("application", application), ("environment", environment)):
        if value is not None:
            incidents = incidents.where(F.col(column) == value)
    if source is not None:
        incidents = incidents.where(F.array_contains("source_paths", source))
    return incidents


def recent_feedback(feedback: DataFrame, limit: int = 10) -> DataFrame:
    return feedback.orderBy(F.desc("created_at"), "id").limit(limit)


def list_sources(sources: DataFrame) -> DataFrame:
    return sources.orderBy("id")

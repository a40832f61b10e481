"""Upserts as table-in, table-out functions, and the partition overwrite that stores them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternlog.schemas import ANALYSES, ANOMALIES, SAMPLES, TEMPLATE_BUCKETS, TEMPLATES, conform
from lanternlog.session import materialize

# Feedback actions that close an incident.
CLOSING_ACTIONS = ("dismiss", "dismissed", "resolve", "resolved", "false_positive", "transient")


def _both(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))


def _earliest(column: str) -> Column:
    """Value from the old table unless it is null there."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("_new"))).alias(column)


def merge_templates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Add up counts, widen the time span, keep pattern and founding message."""
    merged = _both(old, new).groupBy("id").agg(
        *[_earliest(c) for c in ("application", "environment", "template_pattern", "sample_message")],
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("total_count").alias("total_count"),
    )
    return conform(merged, TEMPLATES)


def merge_buckets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Add up the counts of equal bucket ids; the newer sample list replaces the older one."""
    latest = F.max_by("sample_hashes", F.when(F.col("sample_hashes").isNotNull(), F.col("_new")))
    merged = _both(old, new).groupBy(
        "id", "template_id", "application", "environment", "bucket_start", "bucket_end"
    ).agg(
        F.sum("count").alias("count"),
        F.sum("error_count").alias("error_count"),
        latest.alias("sample_hashes"),
    )
    return conform(merged, TEMPLATE_BUCKETS)


def insert_samples(old: DataFrame, new: DataFrame) -> DataFrame:
    """Add samples whose hash is unknown; a known hash keeps its row."""
    fresh = new.join(old.select("sample_hash"), "sample_hash", "left_anti")
    rest = [F.col(c) for c in fresh.columns if c != "sample_hash"]
    order = F.struct("event_ts", "source_path", "line_number")
    once = fresh.groupBy("sample_hash").agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return conform(old.unionByName(once.select("sample_hash", "_row.*")), SAMPLES)


def insert_anomalies(old: DataFrame, new: DataFrame) -> DataFrame:
    """Append unknown anomalies without their sample texts, which must not outlive the samples."""
    fresh = new.join(old.select("id"), "id", "left_anti")
    bare = fresh.withColumn("sample_evidence", F.array().cast("array<string>"))
    return conform(old.unionByName(conform(bare, ANOMALIES)), ANOMALIES)


def merge_analyses(old: DataFrame, new: DataFrame) -> DataFrame:
    """Newer verdicts replace the findings of equal ids; raw model output is never kept."""
    fixed = ("anomaly_id", "model", "prompt_version", "created_at")
    findings = [c for c in ANALYSES.fieldNames() if c not in (*fixed, "id", "raw_response")]
    merged = _both(old, new).groupBy("id").agg(
        *[_earliest(c) for c in fixed],
        F.max_by(F.struct(*findings), "_new").alias("_found"),
    )
    return conform(
        merged.select("id", *fixed, "_found.*").withColumn("raw_response", F.lit(None).cast("string")), ANALYSES
    )


def apply_feedback(anomalies: DataFrame, feedback: DataFrame) -> DataFrame:
    """Anomalies with a closing action become ``dismissed``."""
    closing = feedback.where(F.lower("action").isin(*CLOSING_ACTIONS))
    closed = closing.groupBy(F.col("anomaly_id").alias("id")).agg(F.lit(True).alias("_closed"))
    status = F.when(F.col("_closed"), F.lit("dismissed")).otherwise(F.col("status"))
    return anomalies.join(closed, "id", "left").withColumn("status", status).drop("_closed")


def upsert_sources(old: DataFrame, new: DataFrame, last_seen: DataFrame | None = None) -> DataFrame:
    """Newer configuration replaces the older; the time last seen stays unless there is a newer one."""
    fields = ("application", "environment", "path", "format", "enabled")
    if last_seen is not None:
        new = new.drop("last_seen").join(last_seen, "id", "left")
    rows = _both(old.select("id", *fields, "last_seen"), new.select("id", *fields, "last_seen"))
    known = F.when(F.col("last_seen").isNotNull(), F.col("_new"))
    return rows.groupBy("id").agg(
        F.max_by(F.struct(*fields), "_new").alias("_config"), F.max_by("last_seen", known).alias("last_seen")
    ).select("id", "_config.*", "last_seen")


def sources_last_seen(observations: DataFrame) -> DataFrame:
    return observations.groupBy(F.col("source_id").alias("id")).agg(F.max("event_ts").alias("last_seen"))


def overwrite_partitions(df: DataFrame, path: str, partition: Sequence[str]) -> None:
    """Store ``df`` in place of the partitions it touches.

    ``df`` may be computed from the table at ``path``: it is checkpointed first, so a lost executor cannot
    make Spark read a partition that is already being replaced.
    """
    (
        materialize(df)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition)
        .parquet(path)
    )

"""Job ``sanitize_logs``: events in, events without secrets out, plus an audit of what was removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternlog.functions import redaction
from lanternlog.functions.ids import DEFAULT_SALT, sha256_hex

SOURCE_METADATA = ("service", "host", "container", "source_name")


def sanitize_events(events: DataFrame, salt: str = DEFAULT_SALT) -> DataFrame:
    """Replace ``message`` and ``attributes`` by their redacted forms. One narrow stage, no shuffle."""
    attributes = F.coalesce(F.col("attributes"), F.create_map().cast("map<string,string>"))
    defaults = {name: F.col(name) for name in SOURCE_METADATA if name in events.columns}
    metadata = redaction.safe_attributes(attributes, salt)
    if defaults:
        metadata = redaction.merge_source_metadata(metadata, defaults)
    clean = redaction.with_redaction(events, "message", "sanitized_message", salt=salt)
    return (
        clean.withColumn("client_id_hash", redaction.client_id_hash(attributes))
        .withColumn("metadata", metadata)
        .withColumn("sample_hash", sha256_hex(F.col("sanitized_message")))
        .drop("message", "attributes", "record", "line")
    )


def redaction_audit(sanitized: DataFrame) -> DataFrame:
    """Lines per tag, application and environment.

    The outer explode keeps Spark from testing the list, and so redacting the text, twice.
    """
    return (
        sanitized.select("application", "environment", F.explode_outer("redaction_types").alias("tag"))
        .where(F.col("tag").isNotNull())
        .groupBy("application", "environment", "tag")
        .agg(F.count(F.lit(1)).alias("lines"))
    )

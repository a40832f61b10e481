"""Raw line streams to sanitized observation streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lanternlog.functions.ids import DEFAULT_SALT
from lanternlog.operators.records import assemble_multiline, drop_blank_lines, fallback_event_time, parse_records
from lanternlog.operators.sanitize import sanitize_events
from lanternlog.operators.templates import build_observations
from lanternlog.sources.files import number_lines


def stream_observations(lines: DataFrame, salt: str = DEFAULT_SALT) -> DataFrame:
    """Lines (raw line contract) to observations in one stateless stage; raw text reaches no sink.

    ``line_number`` must tell equal lines of a source apart, for instance a topic offset.
    """
    named = lines.withColumn("record", F.col("line")).withColumn("record_part", F.lit(0))
    events = fallback_event_time(parse_records(named))
    return build_observations(sanitize_events(events, salt))


def deduplicate(observations: DataFrame, delay: str = "24 hours") -> DataFrame:
    """Drop repeats of an observation id that arrive within ``delay``; ids are the same on every delivery."""
    return observations.withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(["id"])


def file_batch(
    batch: DataFrame, batch_id: int, source: dict[str, str], folder: str, salt: str = DEFAULT_SALT
) -> None:
    """Write the observations of the whole files in a micro-batch, multiline records included."""
    changed = batch.groupBy("source_path").agg(F.max("modified").alias("ingest_ts"))
    named = number_lines(batch.select("source_path", "block_start", "line")).join(changed, "source_path")
    for column in ("source_id", "application", "environment", "source_name"):
        named = named.withColumn(column, F.lit(source.get(column)).cast("string"))
    lines = drop_blank_lines(named)
    events = fallback_event_time(parse_records(assemble_multiline(lines)))
    rows = build_observations(sanitize_events(events, salt))
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def start_file_ingest(
    lines: DataFrame, source: dict[str, str], folder: str, checkpoint: str, interval: str = "10 seconds", available_now: bool = False
) -> StreamingQuery:
    """Turn a stream of ``stream_log_files`` into a table of observations, one folder per micro-batch."""
    writer = lines.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.foreachBatch(lambda batch, number: file_batch(batch, number, source, folder)).start()

"""Job ``parse_logs``: raw lines in, events, quarantined lines and parse-quality counts out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternlog.functions import parsing
from lanternlog.operators.ranking import small_table
from lanternlog.session import materialize

# Lines that are put in order together; a longer file is handled in pieces of this many lines.
CHUNK_LINES = 500_000


def drop_blank_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Skip null and blank lines; the remaining lines keep their numbers."""
    return lines.where(parsing.strip(F.col(column)) != "")


def flag_record_start(
    lines: DataFrame, pattern: str | Column | None = None, negate: bool | Column = True
) -> DataFrame:
    """Add ``is_start``. Lines whose column ``whole`` is true are records by themselves, as network input is."""
    start = parsing.starts_record(F.col("line"), pattern, negate)
    if "whole" in lines.columns:
        start = F.coalesce("whole", F.lit(False)) | start
    return lines.withColumn("is_start", start)


def assemble_multiline(
    lines: DataFrame,
    keys: Sequence[str] = ("source_id", "source_path"),
    pattern: str | Column | None = None,
    negate: bool | Column = True,
    chunk_lines: int = CHUNK_LINES,
) -> DataFrame:
    """Join continuation lines to the line that starts their record.

    Files are cut into chunks of line numbers, so one huge file is spread over many tasks. Lines before the first start of
    their chunk belong to a record of an earlier one and are sent there at once, so text is shuffled a single time. Where they
    go comes from a table with one row for each chunk that begins inside a record. A record is one row however long it is; its
    other columns are those of its first line.
    """
    keys = list(keys)
    flagged = flag_record_start(lines, pattern, negate)
    chunked = flagged.withColumn("_chunk", F.floor(F.col("line_number") / chunk_lines))
    by_chunk = [*keys, "_chunk"]
    start = F.when(F.col("is_start"), F.col("line_number"))

    homed = _with_home(chunked, chunk_lines, by_chunk, start)
    so_far = W.partitionBy(*keys, "_home").orderBy("line_number").rowsBetween(W.unboundedPreceding, 0)
    # Lines before the first start of a file are a record of their own.
    placed = homed.withColumn("_start", F.coalesce(F.max(start).over(so_far), F.min("line_number").over(so_far)))
    rest = [c for c in lines.columns if c not in (*keys, "line", "line_number")]
    pieces = F.array_sort(F.collect_list(F.struct("line_number", "line")))
    head = [F.min_by(F.struct(*rest), "line_number").alias("_head")] if rest else []
    joined = placed.groupBy(*keys, "_home", "_start").agg(
        F.array_join(F.transform(pieces, lambda piece: piece["line"]), "\n").alias("record"),
        F.count(F.lit(1)).alias("line_count"),
        *head,
    )
    return joined.select(
        *keys, F.col("_start").alias("line_number"), F.lit(0).alias("record_part"), "record", "line_count",
        *[F.col(f"_head.{c}").alias(c) for c in rest],
    )


def _with_home(chunked: DataFrame, chunk_lines: int, by_chunk: Sequence[str], start: Column) -> DataFrame:
    """Add ``_home``, the chunk in which the record of each line starts.

    The table of chunks that begin inside a record holds nothing of files of one chunk. It goes to all tasks if it is small.
    """
    *keys, _ = by_chunk
    chunks = chunked.groupBy(*by_chunk).agg(
        F.min(start).alias("_first"), F.max(start).alias("_last"), F.min("line_number").alias("_low")
    )
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    # Without a start before, the record is that of the file's first line.
    begun = F.coalesce(F.max("_last").over(before), F.min("_low").over(before))
    inside = chunks.select(*by_chunk, "_first", "_low", F.floor(begun / chunk_lines).alias("_begun")).where(
        F.col("_begun").isNotNull() & (F.col("_first").isNull() | (F.col("_first") > F.col("_low")))
    )
    inside = materialize(inside.select(*[F.col(c).alias(f"_of_{c}") for c in by_chunk], "_first", "_begun"))
    if inside.isEmpty():
        return chunked.withColumnRenamed("_chunk", "_home")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by_chunk])
    found = chunked.join(F.broadcast(inside) if small_table(inside) else inside, same, "left")
    leads = F.col("_first").isNull() | (F.col("line_number") < F.col("_first"))
    home = F.coalesce(F.when(leads, F.col("_begun")), F.col("_chunk"))
    return found.withColumn("_home", home).drop("_chunk", "_first", "_begun", *[f"_of_{c}" for c in by_chunk])


def parse_records(records: DataFrame, record: str = "record", log_format: str | None = None) -> DataFrame:
    """Add ``event_ts`` (null if the record has no time), ``level``, ``message`` and ``attributes``."""
    fmt = F.col(log_format) if log_format else None
    added = ("attributes", "event_ts", "level", "message")
    rest = [c for c in records.columns if c not in added]
    read = records.select(*rest, parsing.parsed(F.col(record), fmt).alias("_parsed"))
    return read.select(*rest, *[F.col(f"_parsed.{name}").alias(name) for name in added])


def fallback_event_time(events: DataFrame) -> DataFrame:
    """Events without a time get their ingestion time, an input column."""
    return events.withColumn("has_time", F.col("event_ts").isNotNull()).withColumn(
        "event_ts", F.coalesce("event_ts", "ingest_ts")
    )


def enrich_from_sources(lines: DataFrame, sources: DataFrame) -> DataFrame:
    """Add the configuration of each line's source; a catalog of few bytes goes to all tasks."""
    config = sources.select(
        F.col("id").alias("source_id"),
        *[c for c in sources.columns if c != "id" and c not in lines.columns],
    )
    config = materialize(config)
    return lines.join(F.broadcast(config) if small_table(config) else config, "source_id", "left")


def quarantine(records: DataFrame, record: str = "record", log_format: str | None = None) -> DataFrame:
    """Rows that look like JSON, or should be, and cannot be read, with the reason."""
    parsed = records if "attributes" in records.columns else parse_records(records, record, log_format)
    claims = parsing.looks_like_json(F.col(record))
    if log_format:
        claims = claims | (F.col(log_format) == "json")
    return parsed.where(claims & F.col("attributes").isNull()).withColumn("reason", F.lit("malformed_json"))


def parse_quality(events: DataFrame, record: str = "record") -> DataFrame:
    """Counts per application and environment that show how well the records could be read."""
    is_json = F.col("attributes").isNotNull()
    return events.groupBy("application", "environment").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(is_json).alias("json_records"),
        F.count_if(~is_json & parsing.looks_like_json(F.col(record))).alias("malformed_json"),
        F.count_if(~F.col("has_time")).alias("without_time"),
        F.count_if(F.col("level") == "UNKNOWN").alias("without_level"),
        F.count_if(F.col(record).contains("\n")).alias("multiline_records"),
    )

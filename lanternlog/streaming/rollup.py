"""Bucket counts of an observation stream, what came too late for them, and what each micro-batch met.

The folder of a rollup holds two ledgers and one table of rows: ``buckets`` (counts, error counts and a mergeable sketch of clients per
template and bucket), ``metrics`` (one row per micro-batch) and ``late`` (the observations behind the watermark). Late events are
counted in the ledger too, under ``late``, so a reader may leave them out or fold them in.
"""

from __future__ import annotations

import uuid
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lanternlog.functions.ids import bucket_id
from lanternlog.functions.levels import is_error
from lanternlog.operators.buckets import BUCKET_MINUTES, KEY, with_bucket
from lanternlog.schemas import BATCH_METRICS, BUCKET_LEDGER
from lanternlog.streaming import ledger

# Events later than the topic keeps its data are late.
LATE_BY_HOURS = 24
_SUMS = {"count": F.sum, "error_count": F.sum, "clients": F.hll_union_agg}
_ROWS = {"rows": F.sum, "late_rows": F.sum}
_EVER = date(9999, 12, 31)


def batch_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, watermark, seen_until, rows, late_rows) of every micro-batch so far."""
    return ledger.totals(spark, f"{folder}/metrics", BATCH_METRICS, _ROWS)


def _seen_until(spark: SparkSession, folder: str, batch_id: int) -> datetime | None:
    """The latest event time before a micro-batch; reads the last days of the metrics only."""
    manifest = ledger.newest(ledger.Files(spark, f"{folder}/metrics"))
    last = max(manifest["days"], default=None)
    days = None if last is None else (date.fromisoformat(last) - timedelta(days=1), _EVER)
    recent = ledger.totals(spark, f"{folder}/metrics", BATCH_METRICS, _ROWS, days, "seen_until")
    return recent.where(F.col("batch") < batch_id).agg(F.max("seen_until")).first()[0]


def bucket_batch(
    batch: DataFrame, batch_id: int, folder: str, minutes: int = BUCKET_MINUTES, late_by_hours: int = LATE_BY_HOURS
) -> None:
    """Add a micro-batch to the ledgers; a repeated batch changes nothing.

    The watermark is the latest event time of earlier batches less ``late_by_hours``; a row is late if its whole bucket lies
    behind it. Numbers of the batch are observed while it is counted; only if some rows were late, it is read once more for them.
    """
    spark = batch.sparkSession
    seen = _seen_until(spark, folder, batch_id)
    watermark = F.lit(None if seen is None else seen - timedelta(hours=late_by_hours)).cast("timestamp")
    flagged = with_bucket(batch, minutes).withColumn("late", F.coalesce(F.col("bucket_end") <= watermark, F.lit(False)))
    met = Observation(f"batch-{batch_id}-{uuid.uuid4().hex}")
    counts = (
        flagged.observe(
            met, F.count(F.lit(1)).alias("rows"), F.count_if("late").alias("late_rows"), F.max("event_ts").alias("seen_until")
        )
        .groupBy(*KEY, "bucket_start", "bucket_end", "late")
        .agg(
            F.count(F.lit(1)).alias("count"), F.count_if(is_error(F.col("level"))).alias("error_count"),
            F.hll_sketch_agg("client_id_hash").alias("clients"),
        )
    )
    ledger.append(counts, f"{folder}/buckets", batch_id)
    numbers = met.get
    if numbers["late_rows"]:
        flagged.where("late").select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
    until = max((t for t in (seen, numbers["seen_until"]) if t is not None), default=None)
    row = spark.createDataFrame([(batch_id, None, until, numbers["rows"], numbers["late_rows"])], BATCH_METRICS)
    ledger.append(row.withColumn("watermark", watermark), f"{folder}/metrics", batch_id)


def start_rollup(
    observations: DataFrame, folder: str, checkpoint: str, minutes: int = BUCKET_MINUTES, late_by_hours: int = LATE_BY_HOURS,
    interval: str = "10 seconds", available_now: bool = False,
) -> StreamingQuery:
    """Keep the bucket ledger in ``folder`` up to date."""
    writer = observations.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.foreachBatch(lambda batch, number: bucket_batch(batch, number, folder, minutes, late_by_hours)).start()


def bucket_totals(
    spark: SparkSession, folder: str, late: bool = False, days: tuple[date, date] | None = None
) -> DataFrame:
    """Running totals per template and bucket; with ``late``, events behind the watermark are folded into their old buckets."""
    rows = ledger.totals(spark, f"{folder}/buckets", BUCKET_LEDGER, _SUMS, days, "bucket_start")
    wanted = rows if late else rows.where(~F.col("late"))
    merged = wanted.groupBy(*KEY, "bucket_start", "bucket_end").agg(*[add(c).alias(c) for c, add in _SUMS.items()])
    return merged.select(bucket_id(F.col("template_id"), F.col("bucket_start")).alias("id"), *merged.columns)


def client_estimate(sketch: str = "clients") -> Column:
    """Distinct clients of a bucket, from its sketch."""
    return F.hll_sketch_estimate(sketch)


def compact(
    spark: SparkSession, folder: str, now: datetime | None = None, keep_hours: int | None = None
) -> dict[str, list[str]]:
    """Fold the deltas of both ledgers into day partitions; with ``now`` and ``keep_hours``, expired days go, and late rows too.

    Returns the days that each ledger keeps. To be run from time to time beside the stream, by one job.
    """
    kept = {
        name: sorted(ledger.compact(spark, f"{folder}/{name}", schema, sums, day_of, now, keep_hours)["days"])
        for name, schema, sums, day_of in (
            ("buckets", BUCKET_LEDGER, _SUMS, "bucket_start"), ("metrics", BATCH_METRICS, _ROWS, "seen_until"),
        )
    }
    if now is not None and keep_hours is not None:
        ledger.expire_batches(spark, f"{folder}/late", "event_ts", now, keep_hours)
    return kept


def with_loss(anomalies: DataFrame, totals: DataFrame) -> DataFrame:
    """Anomalies with ``data_loss_warning``: events of their application and environment came too late for their bucket.

    ``totals`` are rows of the ledger with ``late``.
    """
    lost = totals.where("late").select("application", "environment", "bucket_start").distinct().withColumn("_lost", F.lit(True))
    marked = anomalies.join(lost, ["application", "environment", "bucket_start"], "left")
    return marked.withColumn("data_loss_warning", F.coalesce("_lost", "data_loss_warning")).select(*anomalies.columns)


def ledger_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Sums per template, bucket and ``late``."""
    return ledger.totals(spark, f"{folder}/buckets", BUCKET_LEDGER, _SUMS)

"""Detectors on an observation stream.

Bucket counts and known templates are keyed state of the query (``history``); a micro-batch hands on the buckets that it touched with
those before them, and the batch operators decide about these rows. Only when a bucket crosses its limit, the observations of
that bucket are read, to find the row at which it did. Anomalies are written in partitions named after the micro-batch, so a
batch that is delivered again writes the same files again. No trigger reads what earlier ones wrote, but for one number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lanternlog.operators import buckets as bk
from lanternlog.operators import detection as dt
from lanternlog.operators.ranking import lookup_join
from lanternlog.operators.retention import AGGREGATE_MONTHS, MONTH_DAYS
from lanternlog.schemas import ANOMALIES, conform
from lanternlog.session import materialize
from lanternlog.sources.tables import read_table
from lanternlog.streaming.history import template_histories
from lanternlog.streaming.ledger import Files
from lanternlog.streaming.rollup import LATE_BY_HOURS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Notes of the next incident number that are kept, for batches that are delivered again.
KEPT_NOTES = 50


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Start queries with the state store that keyed state needs; a query keeps the one it was started with."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _next_number(files: Files, batch_id: int) -> int:
    """The first incident number of a micro-batch, as noted by the one before it."""
    earlier = [n for n in files.names("numbers") if n.endswith(".json") and int(n[:-5]) < batch_id]
    return files.read(f"numbers/{earlier[-1]}")["next"] if earlier else 1


def _note_number(files: Files, batch_id: int, number: int) -> None:
    files.put(f"numbers/{batch_id:012d}.json", {"next": number}, replace=True)
    for name in files.names("numbers")[:-KEPT_NOTES]:
        files.delete(f"numbers/{name}")


def crossings(rows: DataFrame, limits: dt.Thresholds) -> DataFrame:
    """Buckets of HISTORY rows whose count crosses the spike limit in this batch."""
    ends = rows.withColumn("bucket_end", F.col("bucket_start") + F.make_dt_interval(mins=F.lit(limits.bucket_minutes)))
    found = dt.spike_buckets(ends.select(*bk.KEY, "bucket_start", "bucket_end", "count", "error_count", "before"), limits)
    return found.where(F.col("trigger_count") > F.col("before"))


def crossing_records(crossed: DataFrame, observations: DataFrame, limits: dt.Thresholds, low: datetime, high: datetime) -> DataFrame:
    """Anomalies of crossed buckets, all between ``low`` and ``high``, from the observations of these buckets alone."""
    near = observations.where(F.col("event_ts").between(F.lit(low), F.lit(high)))
    wanted = crossed.select(
        "template_id", "bucket_start", "baseline_mean", "baseline_std", "trigger_count", F.col("count").alias("_n")
    )
    bucketed = bk.with_bucket(near, limits.bucket_minutes)
    inside = materialize(lookup_join(bucketed, wanted, ["template_id", "bucket_start"], "_n", ["source_path", "line_number"]))
    counted = bk.running_bucket_count(inside, limits.bucket_minutes)
    triggers = counted.where(F.col("running_count") == F.col("trigger_count"))
    return dt.burst_records(triggers, bk.samples(inside), False)


def detection_batch(
    rows: DataFrame, batch_id: int, folder: str, observations: Callable[[], DataFrame], limits: dt.Thresholds = dt.Thresholds()
) -> None:
    """Report the new templates and the crossed buckets of one micro-batch of HISTORY rows."""
    rows = rows.persist()  # the stateful plan runs once
    try:
        end = F.col("bucket_start") + F.make_dt_interval(mins=F.lit(limits.bucket_minutes))
        found = dt.new_template_records(rows.where("first").withColumn("bucket_end", end))
        crossed = materialize(crossings(rows, limits))
        low, high = crossed.agg(F.min("bucket_start"), F.max("bucket_end")).first()
        if low is not None:
            found = dt.union_anomalies(found, crossing_records(crossed, observations(), limits, low, high))
        files = Files(rows.sparkSession, folder)
        number = _next_number(files, batch_id)
        path = f"{folder}/anomalies/batch={batch_id}"
        conform(dt.incident_number(found, number), ANOMALIES).write.mode("overwrite").parquet(path)
        _note_number(files, batch_id, number + rows.sparkSession.read.schema(ANOMALIES).parquet(path).count())
    finally:
        rows.unpersist()


def start_detection(
    stream: DataFrame,
    observations: Callable[[], DataFrame],
    folder: str,
    checkpoint: str,
    limits: dt.Thresholds = dt.Thresholds(),
    known: DataFrame | None = None,
    late_by_hours: int = LATE_BY_HOURS,
    keep_hours: int = AGGREGATE_MONTHS * MONTH_DAYS * 24,
    interval: str = "10 seconds",
    available_now: bool = False,
) -> StreamingQuery:
    """Run the detectors on every micro-batch of ``stream``.

    ``observations`` gives the stored table that the stream reads from. ``known`` is the template dictionary of earlier runs (id,
    application, environment, last_seen). A template is forgotten ``keep_hours`` after its last event; buckets behind the
    watermark of ``late_by_hours`` take no more events.
    """
    histories = template_histories(stream, limits.bucket_minutes, limits.history, late_by_hours, keep_hours, known)
    writer = histories.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    with state_store(stream.sparkSession):
        return writer.foreachBatch(lambda rows, number: detection_batch(rows, number, folder, observations, limits)).start()


def found_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    """Anomalies so far; one that two batches reported counts as of the first."""
    stored = read_table(spark, f"{folder}/anomalies")
    if stored is None:
        return spark.createDataFrame([], ANOMALIES)
    first = F.row_number().over(W.partitionBy("id").orderBy("batch"))
    return conform(stored.withColumn("_rank", first).where("_rank = 1"), ANOMALIES)

"""Job ``rollup``: observations in, time buckets and bounded samples out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternlog.functions.ids import bucket_id
from lanternlog.functions.levels import is_error
from lanternlog.operators.ranking import exact_rank, top_rows
from lanternlog.schemas import LEVELS, OBSERVATION_ORDER, SAMPLES, TEMPLATE_BUCKETS, conform

BUCKET_MINUTES = 5
SAMPLES_PER_BUCKET = 5
SAMPLE_HOURS = 24
KEY = ("template_id", "application", "environment")
# Log lines of one file that are put in order together when a second of a bucket is crowded.
LINES_PER_PART = 65_536


def with_bucket(df: DataFrame, minutes: int = BUCKET_MINUTES, ts: str = "event_ts") -> DataFrame:
    """Add ``bucket_start`` and ``bucket_end``, floors to whole windows in UTC."""
    window = F.window(F.col(ts), f"{minutes} minutes")
    return (
        df.withColumn("_w", window)
        .withColumn("bucket_start", F.col("_w.start"))
        .withColumn("bucket_end", F.col("_w.end"))
        .drop("_w")
    )


def bucket_counts(observations: DataFrame, minutes: int = BUCKET_MINUTES) -> DataFrame:
    """Rows and error rows per template and bucket."""
    slim = observations.select(*KEY, "event_ts", "level")
    return (
        with_bucket(slim, minutes)
        .groupBy(*KEY, "bucket_start", "bucket_end")
        .agg(F.count(F.lit(1)).alias("count"), F.count_if(is_error(F.col("level"))).alias("error_count"))
    )


def bucket_samples(
    observations: DataFrame, minutes: int = BUCKET_MINUTES, per_bucket: int = SAMPLES_PER_BUCKET
) -> DataFrame:
    """The first few distinct sample hashes of each bucket, in order of arrival.

    Repeats of a hash are folded before the first shuffle and each task hands on at most ``per_bucket`` hashes
    of a bucket, so a hot bucket stays small.
    """
    hashed = with_bucket(observations, minutes)
    distinct = hashed.groupBy("template_id", "bucket_start", "sample_hash").agg(F.min("event_ts").alias("arrived"))
    arrival = [F.col("arrived"), F.col("sample_hash")]
    first = top_rows(distinct, ["template_id", "bucket_start"], arrival, per_bucket, "position")
    ordered = F.array_sort(F.collect_list(F.struct("position", "sample_hash")))
    return first.groupBy("template_id", "bucket_start").agg(
        F.transform(ordered, lambda s: s["sample_hash"]).alias("sample_hashes")
    )


def rollup(observations: DataFrame, minutes: int = BUCKET_MINUTES) -> DataFrame:
    """Rows of the bucket contract: counts joined with samples."""
    counts = bucket_counts(observations, minutes)
    joined = counts.join(bucket_samples(observations, minutes), ["template_id", "bucket_start"])
    return conform(joined.withColumn("id", bucket_id(F.col("template_id"), F.col("bucket_start"))), TEMPLATE_BUCKETS)


def samples(observations: DataFrame, hours: int = SAMPLE_HOURS, created: Column | None = None) -> DataFrame:
    """One row per sample hash, its first observation, with an expiry time.

    ``created`` is the time of the run; by default the event time stands in for it.
    """
    columns = [c for c in observations.columns if c in SAMPLES.fieldNames() or c in OBSERVATION_ORDER]
    # Folded before the shuffle, so a message that fills a third of the log leaves one row per task.
    first = (
        observations.groupBy("sample_hash")
        .agg(F.min_by(F.struct(*[c for c in columns if c != "sample_hash"]), F.struct(*OBSERVATION_ORDER)).alias("_row"))
        .select("sample_hash", "_row.*")
    )
    stored = first.withColumn("created_at", created if created is not None else F.col("event_ts"))
    return conform(
        stored.withColumn("expires_at", F.col("created_at") + F.expr(f"INTERVAL {hours} HOURS")), SAMPLES
    )


def bucket_timeline(buckets: DataFrame, limit: int = 30) -> DataFrame:
    """Volume per bucket and application, newest first."""
    return (
        buckets.groupBy("bucket_start", "bucket_end", "application")
        .agg(F.sum("count").alias("total_count"), F.sum("error_count").alias("total_error_count"))
        .orderBy(F.desc("bucket_start"), "application")
        .limit(limit)
    )


def template_totals(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy("template_id").agg(
        F.sum("count").alias("total_count"), F.sum("error_count").alias("total_error_count")
    )


def bucket_severity_counts(
    observations: DataFrame, minutes: int = BUCKET_MINUTES, levels: Sequence[str] = LEVELS
) -> DataFrame:
    """One column of counts per level."""
    return (
        with_bucket(observations.select(*KEY, "event_ts", "level"), minutes)
        .groupBy(*KEY, "bucket_start")
        .agg(*[F.count_if(F.col("level") == level).alias(level.lower()) for level in levels])
    )


def bucket_client_cardinality(
    observations: DataFrame, minutes: int = BUCKET_MINUTES, approximate: bool = False
) -> DataFrame:
    """Distinct clients per template and bucket; the approximate form also works on streams."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return (
        with_bucket(observations.select(*KEY, "event_ts", "client_id_hash"), minutes)
        .groupBy(*KEY, "bucket_start")
        .agg(count(F.col("client_id_hash")).alias("clients"))
    )


def bucket_source_refs(observations: DataFrame, minutes: int = BUCKET_MINUTES) -> DataFrame:
    """First and last event and number of rows per template, bucket and source."""
    return (
        with_bucket(observations.select(*KEY, "event_ts", "source_id"), minutes)
        .groupBy(*KEY, "bucket_start", "source_id")
        .agg(
            F.min("event_ts").alias("first_event"),
            F.max("event_ts").alias("last_event"),
            F.count(F.lit(1)).alias("count"),
        )
    )


def running_bucket_count(
    observations: DataFrame, minutes: int = BUCKET_MINUTES, hot_rows: int = 1_000_000
) -> DataFrame:
    """Add ``running_count``: the rows of the bucket seen so far, this one included."""
    bucketed = observations if "bucket_start" in observations.columns else with_bucket(observations, minutes)
    return exact_rank(
        bucketed,
        ["template_id", "bucket_start"],
        OBSERVATION_ORDER,
        slot=F.date_trunc("second", "event_ts"),
        fine=(
            F.col("event_ts"),
            F.col("source_path"),
            F.floor(F.col("line_number") / LINES_PER_PART).alias("line_part"),
        ),
        rank="running_count",
        hot_rows=hot_rows,
    )


def history_window(size: int = 12) -> W:
    """The ``size`` non-empty buckets of a template before the current one."""
    return W.partitionBy("template_id").orderBy("bucket_start").rowsBetween(-size, -1)


def baseline_stats(buckets: DataFrame, size: int = 12) -> DataFrame:
    """Mean, population deviation and number of the buckets before each bucket."""
    history = history_window(size)
    n = F.count(F.lit(1)).over(history)
    total = F.sum("count").over(history)
    squares = F.sum(F.col("count") * F.col("count")).over(history)
    # Whole numbers keep the deviation of equal counts at exactly zero.
    spread = n * squares - total * total
    return (
        buckets.withColumn("baseline_buckets", n)
        .withColumn("baseline_mean", total / n)
        .withColumn("baseline_std", F.sqrt(spread.cast("double")) / n)
    )


def recent_buckets(buckets: DataFrame, per_template: int = 12) -> DataFrame:
    """The newest buckets of each template."""
    return top_rows(buckets, ["template_id"], [F.desc("bucket_start")], per_template)


def recent_samples(stored: DataFrame, per_template: int = 5) -> DataFrame:
    """The newest samples of each template."""
    return top_rows(stored, ["template_id"], [F.desc("event_ts"), F.col("sample_hash")], per_template)

"""Job ``detect``: buckets, observations and the dictionary in, anomalies out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternlog.functions.ids import row_id
from lanternlog.operators import buckets as bk
from lanternlog.operators.ranking import exact_rank, lookup_join, top_rows
from lanternlog.operators.templates import flag_new_templates
from lanternlog.schemas import ANOMALIES, ERROR_LEVELS, WARN_LEVELS, conform
from lanternlog.session import materialize


@dataclass(frozen=True)
class Thresholds:
    """When a bucket counts as a spike."""

    z_score: float = 3.0
    min_count: int = 5
    history: int = 12
    min_history: int = 3
    bucket_minutes: int = 5


DETECTOR_VERSION = "v1"
# Fixed value: score of a jump over a history without any spread.
FLAT_HISTORY_SCORE = 4.0
EVIDENCE_SAMPLES = 3
# Up to this many anomalies are numbered by one task, more by slots of their hash; the numbers are the same.
ONE_TASK_ROWS = 100_000


def zscore(count: Column, mean: Column, std: Column) -> Column:
    """Distance from the mean in deviations; over a flat history a clear jump scores a fixed value."""
    jump = F.when(count > mean * 3 + 5, F.lit(FLAT_HISTORY_SCORE)).otherwise(F.lit(0.0))
    return F.when(std > 0, (count - mean) / std).otherwise(jump)


def score_buckets(buckets: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Buckets with baseline and ``z_score`` (null where the history is too short or the count too low)."""
    based = bk.baseline_stats(buckets, limits.history)
    enough = (F.col("baseline_buckets") >= limits.min_history) & (F.col("count") >= limits.min_count)
    score = zscore(F.col("count"), F.col("baseline_mean"), F.col("baseline_std"))
    return based.withColumn("z_score", F.when(enough, score))


def spike_buckets(buckets: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Buckets above the threshold, with ``trigger_count``: the smallest count that crosses it.

    The score grows with the count, so the buckets that cross can be found from counts alone and only their
    rows have to be looked at again.
    """
    scored = score_buckets(buckets, limits).where(F.col("z_score") >= limits.z_score)
    mean, std = F.col("baseline_mean"), F.col("baseline_std")
    guess = F.ceil(mean + limits.z_score * std)
    # Rounding may put the guess one off; the score itself decides.
    by_score = (
        F.when((guess - 1 - mean) / std >= limits.z_score, guess - 1)
        .when((guess - mean) / std >= limits.z_score, guess)
        .otherwise(guess + 1)
    )
    by_jump = F.floor(mean * 3 + 5) + 1
    crossing = F.when(std > 0, by_score).otherwise(by_jump)
    return scored.withColumn("trigger_count", F.greatest(crossing, F.lit(limits.min_count)).cast("bigint"))


def spike_triggers(
    observations: DataFrame,
    spikes: DataFrame,
    limits: Thresholds = Thresholds(),
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """The observation of each spike bucket at which the running count reaches ``trigger_count``."""
    wanted = spikes.select("template_id", "bucket_start", "baseline_mean", "baseline_std", "trigger_count", F.col("count").alias("_n"))
    bucketed = bk.with_bucket(observations, limits.bucket_minutes)
    # Few rows are left, and the ranking reads them several times. The buckets wanted are the most crowded ones, so they are
    # sent to all tasks or dealt out.
    inside = materialize(lookup_join(bucketed, wanted, ["template_id", "bucket_start"], "_n", ["source_path", "line_number"]))
    counted = bk.running_bucket_count(inside, limits.bucket_minutes, hot_rows)
    return counted.where(F.col("running_count") == F.col("trigger_count"))


def incident_number(anomalies: DataFrame, start_at: int = 1) -> DataFrame:
    """Number incidents ``INC0000001`` onward, without gaps or repeats, in the order of the hash of their id.

    Pass the next free number as ``start_at`` when earlier incidents exist.
    """
    # The ranking reads the anomalies twice.
    kept = materialize(anomalies)
    hashed = kept.withColumn("_hash", F.sha2("id", 256)).withColumn("_all", F.lit(1))
    if kept.count() <= ONE_TASK_ROWS:
        ranked = hashed.withColumn("_number", F.row_number().over(W.partitionBy("_all").orderBy("_hash")))
    else:
        ranked = exact_rank(hashed, ["_all"], ["_hash"], slot=F.substring("_hash", 1, 4), rank="_number")
    number = F.format_string("INC%07d", F.col("_number") + (start_at - 1))
    return ranked.withColumn("incident_number", number).drop("_hash", "_all", "_number")


def anomaly_record(triggers: DataFrame, data_loss: bool = False) -> DataFrame:
    """Trigger rows with type, counts and evidence to rows of the anomaly contract."""
    reference = F.struct(
        "template_id",
        "source_id",
        "source_path",
        "line_number",
        F.col("event_ts").alias("timestamp"),
        "sample_hash",
    )
    rows = (
        triggers.withColumn("id", row_id(F.col("anomaly_type"), F.col("template_id"), F.unix_micros("bucket_start")))
        .withColumn("detected_at", F.col("event_ts"))
        .withColumn("baseline_count", F.round("baseline_count", 2))
        .withColumn("z_score", F.round("z_score", 2))
        .withColumn("status", F.lit("active"))
        .withColumn("source_paths", F.array("source_path"))
        .withColumn("related_template_ids", F.array("template_id"))
        .withColumn("evidence_references", F.array(reference))
        .withColumn("detector_version", F.lit(DETECTOR_VERSION))
        .withColumn("data_loss_warning", F.lit(data_loss))
    )
    return conform(rows, ANOMALIES)


def new_template_records(first: DataFrame, data_loss: bool = False) -> DataFrame:
    """First observations of templates, with their buckets, to anomalies."""
    triggers = (
        first.withColumn("anomaly_type", F.lit("new_template"))
        .withColumn("current_count", F.lit(1))
        .withColumn("baseline_count", F.lit(0.0))
        .withColumn("z_score", F.lit(None).cast("double"))
        .withColumn("sample_evidence", F.array("sanitized_message"))
    )
    return anomaly_record(triggers, data_loss)


def detect_new_templates(
    observations: DataFrame, known: DataFrame | None = None, limits: Thresholds = Thresholds(), data_loss: bool = False
) -> DataFrame:
    """One anomaly at the first sight of each unknown template."""
    return new_template_records(bk.with_bucket(flag_new_templates(observations, known), limits.bucket_minutes), data_loss)


def with_evidence(triggers: DataFrame, samples: DataFrame | None, newest: int = EVIDENCE_SAMPLES) -> DataFrame:
    """Add ``sample_evidence``: the newest samples of the template, else the trigger's own message."""
    own = F.array("sanitized_message")
    if samples is None:
        return triggers.withColumn("sample_evidence", own)
    wanted = triggers.select("template_id").distinct()
    recent = bk.recent_samples(samples.join(wanted, "template_id", "left_semi"), newest)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "sanitized_message")))
    listed = recent.groupBy("template_id").agg(
        F.transform(ordered, lambda s: s["sanitized_message"]).alias("_evidence")
    )
    return (
        triggers.join(listed, "template_id", "left")
        .withColumn("sample_evidence", F.coalesce("_evidence", own))
        .drop("_evidence")
    )


def burst_records(triggers: DataFrame, samples: DataFrame | None, data_loss: bool) -> DataFrame:
    """Trigger rows with baseline columns to anomalies."""
    burst = F.col("level").isin(*ERROR_LEVELS)
    typed = (
        triggers.withColumn("anomaly_type", F.when(burst, F.lit("error_burst")).otherwise(F.lit("frequency_spike")))
        .withColumn("current_count", F.col("trigger_count"))
        .withColumn("baseline_count", F.col("baseline_mean"))
        .withColumn("z_score", zscore(F.col("trigger_count"), F.col("baseline_mean"), F.col("baseline_std")))
    )
    return anomaly_record(with_evidence(typed, samples), data_loss)


def detect_spikes(
    observations: DataFrame,
    samples: DataFrame | None = None,
    limits: Thresholds = Thresholds(),
    data_loss: bool = False,
    buckets: DataFrame | None = None,
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """Frequency spikes and error bursts together; the trigger's level decides between them."""
    counts = buckets if buckets is not None else bk.bucket_counts(observations, limits.bucket_minutes)
    triggers = spike_triggers(observations, spike_buckets(counts, limits), limits, hot_rows)
    return burst_records(triggers, samples, data_loss)


def detect_frequency_spikes(observations: DataFrame, **options) -> DataFrame:
    return detect_spikes(observations, **options).where(F.col("anomaly_type") == "frequency_spike")


def detect_error_bursts(observations: DataFrame, **options) -> DataFrame:
    return detect_spikes(observations, **options).where(F.col("anomaly_type") == "error_burst")


def detect_level_bursts(
    observations: DataFrame, levels: Sequence[str] = WARN_LEVELS, limits: Thresholds = Thresholds()
) -> DataFrame:
    """Buckets in which the rows of the given levels alone pass the spike rule."""
    of_level = observations.where(F.col("level").isin(*levels))
    return spike_buckets(bk.bucket_counts(of_level, limits.bucket_minutes), limits)


def union_anomalies(*parts: DataFrame) -> DataFrame:
    """Put the results of several detectors into one table; their ids differ by type."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def detect(
    observations: DataFrame,
    known: DataFrame | None = None,
    samples: DataFrame | None = None,
    limits: Thresholds = Thresholds(),
    data_loss: bool = False,
    start_at: int = 1,
    buckets: DataFrame | None = None,
) -> DataFrame:
    """All detectors, numbered."""
    found = union_anomalies(
        detect_new_templates(observations, known, limits, data_loss),
        detect_spikes(observations, samples, limits, data_loss, buckets),
    )
    return conform(incident_number(found, start_at), ANOMALIES)


def cap_batches(anomalies: DataFrame, size: int = 10, seconds: int = 60) -> DataFrame:
    """Add ``in_batch``; anomalies beyond ``size`` per application, environment and interval become ``failed``.

    The last row that still fits is found per batch, so no batch is sorted as a whole.
    """
    keys = ["application", "environment", "batch_start"]
    batched = anomalies.withColumn("batch_start", F.window("detected_at", f"{seconds} seconds")["start"])
    place = F.struct("detected_at", "id")
    first = top_rows(batched.select(*keys, "detected_at", "id"), keys, [F.col("detected_at"), F.col("id")], size)
    last = first.groupBy(*keys).agg(F.max(place).alias("_last"))
    fits = place <= F.col("_last")
    return (
        batched.join(last, keys)
        .withColumn("in_batch", fits)
        .withColumn("status", F.when(fits, F.col("status")).otherwise(F.lit("failed")))
        .drop("_last")
    )

"""Triage of an anomaly stream in timed batches."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lanternlog.operators import memory, triage
from lanternlog.operators.detection import cap_batches
from lanternlog.schemas import ANALYSES, EMBEDDINGS, LEASES, conform
from lanternlog.sources.tables import read_table


def recalled(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """Memory records of earlier micro-batches and of resolutions."""
    verdicts = read_table(spark, f"{folder}/memory")
    resolutions = conform(read_table(spark, f"{folder}/resolutions", EMBEDDINGS), EMBEDDINGS)
    if verdicts is None:
        return resolutions
    return conform(verdicts.where(F.col("batch") < batch_id), EMBEDDINGS).unionByName(resolutions)


def remember_resolutions(anomalies: DataFrame, feedback: DataFrame, folder: str, run: str) -> None:
    """Let later batches recall how operators resolved incidents; a repeated ``run`` replaces its own records."""
    memory.index_resolutions(anomalies, feedback).write.mode("overwrite").parquet(f"{folder}/resolutions/run={run}")


def triage_batch(batch: DataFrame, batch_id: int, folder: str, size: int = 10, seconds: int = 60) -> None:
    """Write the verdicts, statuses and memory records of one batch; a repeated batch replaces its own files.

    Batches recall the verdicts of earlier ones, and all resolutions that were remembered.
    """
    spark = batch.sparkSession
    capped = cap_batches(batch, size, seconds)
    accepted = capped.where("in_batch").select(*batch.columns)
    # Written first: until the verdicts are there, or the lease ends, the incidents are being analyzed.
    triage.take_leases(accepted, F.lit(datetime.now(UTC))).write.mode("overwrite").parquet(f"{folder}/leases/batch={batch_id}")
    verdicts = triage.heuristic_triage(accepted)
    known = recalled(spark, folder, batch_id)
    if known.head(1):
        verdicts = triage.apply_past_resolutions(verdicts, accepted, known)
    verdicts.write.mode("overwrite").parquet(f"{folder}/analyses/batch={batch_id}")
    written = spark.read.schema(ANALYSES).parquet(f"{folder}/analyses/batch={batch_id}")
    learned = memory.index_records(accepted, written)
    learned.write.mode("overwrite").parquet(f"{folder}/memory/batch={batch_id}")
    status = capped.select("id", F.when(F.col("in_batch"), "analyzed").otherwise("failed").alias("status"))
    status.write.mode("overwrite").parquet(f"{folder}/statuses/batch={batch_id}")


def current_statuses(spark: SparkSession, folder: str, anomalies: DataFrame, feedback: DataFrame, now: datetime) -> DataFrame:
    """Anomalies with their status at ``now``, from the leases and verdicts of the stream; those over the cap are failed."""
    leases = conform(read_table(spark, f"{folder}/leases", LEASES), LEASES)
    verdicts = conform(read_table(spark, f"{folder}/analyses", ANALYSES), ANALYSES)
    over = read_table(spark, f"{folder}/statuses")
    if over is not None:
        failed = over.where(F.col("status") == "failed").select("id", F.lit(True).alias("_over")).distinct()
        status = F.when(F.col("_over"), "failed").otherwise(F.col("status"))
        anomalies = anomalies.join(failed, "id", "left").withColumn("status", status).drop("_over")
    return triage.status_lifecycle(anomalies, verdicts, feedback, leases, F.lit(now))


def start_triage(
    anomalies: DataFrame, folder: str, checkpoint: str, seconds: int = 60, available_now: bool = False
) -> StreamingQuery:
    writer = anomalies.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.foreachBatch(lambda batch, number: triage_batch(batch, number, folder, seconds=seconds)).start()

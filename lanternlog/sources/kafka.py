"""Kafka topics: raw logs in, typed rows in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lanternlog.functions.parsing import first_filled, strict_object
from lanternlog.schemas import ANALYSES, ANOMALIES, OBSERVATIONS

# Names under which a raw message carries its text and its origin.
TEXT_KEYS = ("message", "log")
APPLICATION_KEYS = ("application", "app")
ENVIRONMENT_KEYS = ("environment", "env")
SOURCE_KEYS = ("source_name", "tag")
# Times in messages keep their microseconds.
TIME_FORMAT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def read_topic(spark: SparkSession, servers: str, topic: str, streaming: bool = True, **options: str) -> DataFrame:
    """Rows of a topic; needs the Kafka connector on the class path."""
    reader = spark.readStream if streaming else spark.read
    return (
        reader.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
    )


def write_topic(messages: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    """Start a query that sends ``key`` and ``value`` to a topic."""
    return (
        messages.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .start()
    )


def decode_raw(records: DataFrame, environment: str, topic: str = "raw_logs", keep_json: bool = True) -> DataFrame:
    """Values of the raw topic to lines with their origin.

    A JSON object gives its ``message`` or ``log``; anything else is the line itself. With ``keep_json`` the
    object stays the line, so that its time, level and attributes are parsed too. Each message is a record by itself.
    Without partition and offset the message's digest tells lines apart, so equal messages count as one.
    """
    text = F.make_valid_utf8(F.col("value").cast("string"))
    braces = text.startswith("{") & text.endswith("}")
    attributes = F.when(braces, strict_object(text))
    decoded = records.withColumn("_text", text).withColumn("_map", attributes)
    pick = lambda names, fallback: F.coalesce(first_filled(F.col("_map"), names), F.lit(fallback))
    message = F.coalesce(first_filled(F.col("_map"), TEXT_KEYS), F.col("_text"))
    named = (
        decoded.withColumn("application", pick(APPLICATION_KEYS, "kafka-raw"))
        .withColumn("environment", pick(ENVIRONMENT_KEYS, environment))
        .withColumn("source_name", pick(SOURCE_KEYS, "kafka-stream"))
        .withColumn("message", message)
        .withColumn("line", F.col("_text") if keep_json else message)
        .withColumn("source_path", F.lit(f"kafka://{topic}"))
    )
    if {"partition", "offset"} <= set(records.columns):
        # The place in the topic tells equal lines apart.
        place = F.concat_ws("/", "source_path", F.col("partition").cast("string"))
        named = named.withColumn("source_path", place).withColumn("line_number", F.col("offset"))
    elif "line_number" not in records.columns:
        place = F.concat_ws("/", "source_path", F.sha2(F.col("_text"), 256))
        named = named.withColumn("source_path", place).withColumn("line_number", F.lit(1).cast("bigint"))
    if "ingest_ts" not in records.columns and "timestamp" in records.columns:
        named = named.withColumn("ingest_ts", F.col("timestamp").cast("timestamp"))
    named = named.withColumn("whole", F.lit(True))
    return named.withColumn("source_id", F.concat_ws("-", F.lit("ingest"), "application", "environment")).drop(
        "_text", "_map", "value"
    )


def decode_typed(records: DataFrame, schema: T.StructType, required: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Values of a typed topic to rows, and the values that lack a required field or cannot be read."""
    text = F.make_valid_utf8(F.col("value").cast("string"))
    parsed = records.select(text.alias("value"), F.from_json(text, schema).alias("row"))
    complete = F.lit(True)
    for name in required:
        complete = complete & F.col("row")[name].isNotNull()
    complete = F.coalesce(complete, F.lit(False))
    bad = parsed.where(~complete).select("value", F.lit("invalid_message").alias("reason"))
    return parsed.where(complete).select("row.*"), bad


def decode_observations(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    required = ("source_id", "application", "environment", "template_id", "template_text", "sanitized_message",
                "event_ts", "source_path", "sample_hash")
    return decode_typed(records, OBSERVATIONS, required)


def decode_anomalies(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    required = ("application", "environment", "template_id", "anomaly_type", "bucket_start", "current_count",
                "template_text")
    return decode_typed(records, ANOMALIES, required)


def decode_analyses(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    required = ("anomaly_id", "model", "prompt_version", "severity", "confidence", "created_at")
    return decode_typed(records, ANALYSES, required)


def _message(df: DataFrame, key: Column, schema: T.StructType) -> DataFrame:
    return df.select(key.alias("key"), F.to_json(F.struct(*schema.fieldNames()), TIME_FORMAT).alias("value"))


def encode_observations(observations: DataFrame) -> DataFrame:
    """Messages keyed by application and environment."""
    return _message(observations, F.concat_ws("::", "application", "environment"), OBSERVATIONS)


def encode_anomalies(anomalies: DataFrame) -> DataFrame:
    return _message(anomalies, F.concat_ws("::", "application", "environment"), ANOMALIES)


def encode_analyses(analyses: DataFrame) -> DataFrame:
    return _message(analyses, F.col("anomaly_id"), ANALYSES)

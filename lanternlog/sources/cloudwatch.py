"""Subscription payloads of a cloud log service: base64 of gzipped JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAYLOAD = "struct<logGroup:string,logStream:string,logEvents:array<struct<id:string,timestamp:bigint,message:string>>>"


def gunzip(data: Column | str) -> Column:
    """Text of gzipped bytes, null if they are not gzip. Spark has no built-in for it.

    A plain function on purpose: a worker holds the unpacked texts of a hundred payloads, not of an Arrow batch of ten thousand. It
    counts as not deterministic, so that a filter on the text does not unpack it once more.
    """

    def text(packed: bytes | None) -> str | None:
        import gzip
        import zlib

        try:
            return None if packed is None else gzip.decompress(packed).decode("utf-8")
        except (OSError, EOFError, zlib.error, UnicodeDecodeError):
            return None

    return F.udf(text, T.StringType(), useArrow=False).asNondeterministic()(data)


def decode_cloudwatch(
    payloads: DataFrame, environment: str = "production", application: str = "", data: str = "data", ingest_ts: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Payloads to raw lines, and the payloads that cannot be read.

    The application is the log group with dashes for slashes unless one is given. Empty messages and empty
    payloads give no lines. Each message is a record by itself; the path names group, stream and payload, by the column
    ``payload_id`` or else by the payload's digest. ``ingest_ts`` is that of the payload, or the time of the run for a table
    without it.
    """
    if "ingest_ts" not in payloads.columns:
        payloads = payloads.withColumn("ingest_ts", F.lit(ingest_ts).cast("timestamp") if ingest_ts else F.current_timestamp())
    key = F.col("payload_id").cast("string") if "payload_id" in payloads.columns else F.sha2(data, 256)
    filled = payloads.where(F.coalesce(F.col(data), F.lit("")) != "")
    packed = F.when(F.length(data) > 0, F.try_to_binary(F.col(data), F.lit("base64")))
    text = filled.withColumn("_json", gunzip(packed))
    parsed = text.withColumn("_log", F.when(F.try_parse_json("_json").isNotNull(), F.from_json("_json", PAYLOAD)))
    bad = parsed.where(F.col("_log").isNull()).select(data, F.lit("unreadable_payload").alias("reason"))
    group = F.coalesce(F.col("_log.logGroup"), F.lit("unknown-loggroup"))
    stream = F.coalesce(F.col("_log.logStream"), F.lit("unknown-stream"))
    name = F.lit(application) if application else F.btrim(F.replace(group, F.lit("/"), F.lit("-")), F.lit("-"))
    rest = [c for c in payloads.columns if c != data]
    lines = (
        parsed.where(F.col("_log").isNotNull())
        .select(*rest, key.alias("_key"), group.alias("_group"), name.alias("application"), stream.alias("stream"),
                F.posexplode("_log.logEvents").alias("_pos", "_event"))
        .where(F.coalesce(F.col("_event.message"), F.lit("")) != "")
        .select(
            *rest,
            "application",
            F.lit(environment).alias("environment"),
            F.concat(F.lit("cloudwatch:"), F.col("_group")).alias("source_name"),
            F.concat_ws("-", F.lit("ingest"), "application", F.lit(environment)).alias("source_id"),
            F.concat_ws("/", F.concat(F.lit("cloudwatch:"), F.col("_group")), "stream", "_key").alias("source_path"),
            F.lit(True).alias("whole"),
            (F.col("_pos") + 1).cast("bigint").alias("line_number"),
            F.col("_event.message").alias("message"),
            F.col("_event.timestamp").alias("timestamp_ms"),
            "stream",
        )
    )
    return lines.withColumn("line", F.to_json(F.struct("message", "timestamp_ms", "stream"))), bad

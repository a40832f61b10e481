"""Log-shaped views of the provided tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternlog.functions.ids import sha256_hex, template_id

#: Rows of a provided table that a task works on, and of one that holds long texts.
TASK_ROWS, TEXT_ROWS = 50_000, 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """Deal the rows of a table out evenly, to all cores at least and about ``rows`` to a task at most.

    The number of input splits does not tell how rows lie in them: a file of one row group is many splits, one of which has all rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)))


def _ts(column: str = "ts") -> Column:
    return F.col(column).cast("timestamp")


def _application() -> Column:
    return F.concat(F.lit("app-"), (F.col("user_id") % 4).cast("string"))


def _environment() -> Column:
    return F.when(F.col("user_id") % 10 < 7, "production").otherwise("staging")


def _level() -> Column:
    return F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").otherwise("INFO")


def event_observations(spark: SparkSession, sf_dir: str, scoped: bool = True, dealt: bool = False) -> DataFrame:
    """``events`` as observations, one template per event type.

    Unscoped, all rows belong to one application, which makes buckets dense enough for spikes. With ``dealt``, rows are dealt out
    evenly first, for callers that write them.
    """
    application = _application() if scoped else F.lit("app")
    environment = _environment() if scoped else F.lit("production")
    message = F.concat_ws(" ", "event_type", "props")
    pattern = F.concat(F.col("event_type"), F.lit(" request by user <NUM> took <DURATION>"))
    events = table(spark, sf_dir, "events")
    return (spread(events) if dealt else events).select(
        F.col("event_id").cast("string").alias("id"),
        F.concat_ws("-", F.lit("ingest"), application, environment).alias("source_id"),
        application.alias("application"),
        environment.alias("environment"),
        template_id(pattern, application, environment).alias("template_id"),
        pattern.alias("template_text"),
        message.alias("sanitized_message"),
        _level().alias("level"),
        _ts().alias("event_ts"),
        _ts().alias("ingest_ts"),
        F.concat(F.lit("/logs/"), application, F.lit(".log")).alias("source_path"),
        F.col("event_id").alias("line_number"),
        sha256_hex(message).alias("sample_hash"),
        sha256_hex(F.col("user_id").cast("string")).alias("client_id_hash"),
    )


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as raw lines: every third one JSON, the others text."""
    stamp = F.date_format(_ts(), "yyyy-MM-dd HH:mm:ss.SSS")
    user, value = F.col("user_id").cast("string"), F.col("value").cast("string")
    text = F.concat(
        stamp, F.lit(" ["), _level(), F.lit("] "), _application(), F.lit(": "), F.col("event_type"),
        F.lit(" for user_id="), user, F.lit(" from 10.0."), (F.col("user_id") % 8).cast("string"), F.lit("."), user,
        F.lit(" mail u"), user, F.lit("@example.com took "), value, F.lit("ms"),
    )
    status = F.when(F.col("event_type") == "error", "500").otherwise("200")
    json = F.concat(
        F.lit('{"timestamp": "'), F.replace(stamp, F.lit(" "), F.lit("T")), F.lit('Z", "level": "'), _level(),
        F.lit('", "service": "'), _application(), F.lit('", "client_id": "'), user,
        F.lit('", "http_status": '), status, F.lit(', "message": "'), F.col("event_type"),
        F.lit(" done value="), value, F.lit('"}'),
    )
    return spread(table(spark, sf_dir, "events")).select(
        F.concat_ws("-", F.lit("ingest"), _application(), _environment()).alias("source_id"),
        _application().alias("application"),
        _environment().alias("environment"),
        F.concat(F.lit("/logs/"), _application(), F.lit("-"), _environment(), F.lit(".log")).alias("source_path"),
        F.col("event_id").alias("line_number"),
        F.when(F.col("event_id") % 3 == 0, json).otherwise(text).alias("line"),
        _ts().alias("ingest_ts"),
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files of text lines."""
    return (
        spread(table(spark, sf_dir, "documents"), TEXT_ROWS)
        .select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select(
            "doc_id",
            F.concat(F.lit("docs-"), F.col("source")).alias("source_id"),
            F.col("source").alias("application"),
            F.col("lang").alias("environment"),
            F.concat(F.lit("/docs/"), F.col("doc_id").cast("string")).alias("source_path"),
            (F.col("pos") + 1).cast("bigint").alias("line_number"),
            "line",
            F.timestamp_seconds(F.col("doc_id") + 1704067200).alias("ingest_ts"),
        )
    )


def multiline_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_lines`` in which every error line is followed by two continuation lines."""
    lines = event_lines(spark, sf_dir)
    number = F.col("line_number")
    trace = F.array(
        F.struct((number * 3).alias("line_number"), F.col("line").alias("line")),
        F.struct(
            (number * 3 + 1).alias("line_number"),
            F.concat(F.lit("   at step("), F.col("source_path"), F.lit(":"), number.cast("string"), F.lit(")")).alias("line"),
        ),
        F.struct(
            (number * 3 + 2).alias("line_number"),
            F.concat(F.lit("Caused by: code "), (number % 7).cast("string")).alias("line"),
        ),
    )
    failed = F.col("line").contains("[ERROR]")
    pieces = F.explode(F.when(failed, trace).otherwise(F.slice(trace, 1, 1))).alias("piece")
    rest = [c for c in lines.columns if c not in ("line", "line_number")]
    return lines.select(*rest, pieces).select(*rest, "piece.line_number", "piece.line")


def secret_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_lines``, each with a value that must be redacted or masked at the end of its message, one of ten kinds."""
    user = F.regexp_extract("line", r'(?:user_id=|"client_id": ")([0-9]+)', 1)
    four = F.lpad(F.right(user, F.lit(4)), 4, "0")
    values = [
        F.concat(F.lit("token eyJhbGciOiJIUzI1NiJ9.eyJ1aWQi"), user, F.lit(".c2lnbmF0dXJl")),
        F.concat(F.lit("Authorization: Bearer tok"), user, F.lit(".x")),
        F.concat(F.lit("api_key=k"), user),
        F.concat(F.lit("id 123e4567-e89b-12d3-a456-"), F.lpad(user, 12, "0")),
        F.concat(F.lit("peer 2001:0db8:0000:0000:0000:ff00:0042:"), four),
        F.concat(F.lit("digest "), F.md5(user)),
        F.concat(F.lit("GET https://example.com/path/"), user, F.lit("?q=1")),
        F.concat(F.lit("mac 00:1a:2b:3c:4d:"), F.right(four, F.lit(2))),
        F.concat(F.lit("open /var/log/app/"), user, F.lit(".log")),
        F.concat(F.lit("card 4111 1111 1111 "), four),
    ]
    lines = event_lines(spark, sf_dir)
    kind = (F.col("line_number") % len(values)).cast("int")
    value = F.concat(F.lit(" "), F.element_at(F.array(*values), kind + 1))
    inside = F.concat(F.expr("left(line, length(line) - 2)"), value, F.lit('"}'))
    return lines.withColumn("line", F.when(F.col("line_number") % 3 == 0, inside).otherwise(F.concat("line", value)))


def configured_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as records of three sources with rules of their own, continuation lines included: ``source``, ``record``."""
    number = F.col("line_number").cast("string")
    note = F.concat(F.lit("\nnote of "), number)
    trace = F.concat(F.lit("job "), number, F.lit(" stopped\n   at step("), number, F.lit(")\n   at main"))
    json = F.col("line_number") % 3 == 0
    traced = F.col("line_number") % 3 == 1
    return event_lines(spark, sf_dir).select(
        "line_number",
        F.when(json, "json").when(traced, "trace").otherwise("dated").alias("source"),
        F.when(json, F.col("line")).when(traced, trace).otherwise(F.concat("line", note)).alias("record"),
    )

"""Table contracts. Field order is part of the contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Domains of the enumerated columns.
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "WARNING", "ERROR", "CRITICAL", "FATAL", "UNKNOWN")
ERROR_LEVELS = ("ERROR", "CRITICAL", "FATAL")
WARN_LEVELS = ("WARN", "WARNING")
ANOMALY_TYPES = ("new_template", "frequency_spike", "error_burst")
ANOMALY_STATUSES = ("active", "dismissed", "analyzing", "analyzed", "failed")
OPEN_STATUSES = ("active", "analyzing", "analyzed", "failed")
SEVERITIES = ("Sev-0", "Sev-1", "Sev-2", "Sev-3", "Sev-4")
CONFIDENCES = ("very-low", "low", "medium", "high", "very-high")

_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
    "timestamp": T.TimestampType(),
    "strings": T.ArrayType(T.StringType()),
    "floats": T.ArrayType(T.FloatType()),
    "map": T.MapType(T.StringType(), T.StringType()),
    "maps": T.ArrayType(T.MapType(T.StringType(), T.StringType())),
}


def _schema(columns: str) -> T.StructType:
    """Schema from ``name type`` pairs; unlike DDL it needs no running session."""
    fields = [pair.split() for pair in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


_TYPES["references"] = T.ArrayType(
    _schema(
        "template_id string, source_id string, source_path string, line_number bigint, timestamp timestamp,"
        "sample_hash string"
    )
)

SOURCES = _schema(
    "id string, application string, environment string, path string,"
    "format string, multiline_pattern string, multiline_negate boolean, service string, host string,"
    "container string, source_name string, enabled boolean"
)
RAW_LINES = _schema(
    "source_id string, application string, environment string, source_name string, source_path string,"
    "line_number bigint, line string, ingest_ts timestamp"
)
# Raw lines with the settings of their source.
SETTLED_LINES = T.StructType(
    [*RAW_LINES.fields, *_schema("format string, multiline_pattern string, multiline_negate boolean").fields]
)
# The place of a source's files (the folder before any wildcard, and the whole as a pattern) and what its lines get.
SOURCE_FILES = _schema(
    "_root string, _pattern string, source_id string, application string, environment string, source_name string,"
    "format string, multiline_pattern string, multiline_negate boolean"
)
OBSERVATIONS = _schema(
    "id string, source_id string, application string, environment string, template_id string,"
    "template_text string, sanitized_message string, level string, event_ts timestamp, ingest_ts timestamp,"
    "source_path string, line_number bigint, parameters strings, sample_hash string,"
    "client_id_hash string, metadata map, redaction_types strings"
)
TEMPLATES = _schema(
    "id string, application string, environment string, template_pattern string, first_seen timestamp,"
    "last_seen timestamp, total_count bigint, sample_message string"
)
TEMPLATE_VERSIONS = _schema(
    "template_id string, application string, environment string, version bigint, template_pattern string, rules string,"
    "valid_from timestamp"
)
TEMPLATE_BUCKETS = _schema(
    "id string, template_id string, application string, environment string, bucket_start timestamp,"
    "bucket_end timestamp, count bigint, error_count bigint, sample_hashes strings"
)
SAMPLES = _schema(
    "sample_hash string, template_id string, source_id string, application string, environment string,"
    "sanitized_message string, level string, event_ts timestamp, line_number bigint, source_path string,"
    "created_at timestamp, expires_at timestamp"
)
ANOMALIES = _schema(
    "id string, incident_number string, application string, environment string, template_id string,"
    "anomaly_type string, detected_at timestamp, bucket_start timestamp, current_count bigint,"
    "baseline_count double, z_score double, status string, template_text string,"
    "sample_evidence strings, source_paths strings, related_template_ids strings,"
    "evidence_references references, detector_version string, data_loss_warning boolean"
)
ANALYSES = _schema(
    "id string, anomaly_id string, model string, prompt_version string, severity string, confidence string,"
    "investigate boolean, summary string, evidence maps, possible_causes strings,"
    "recommended_actions strings, limitations strings, raw_response string, error string,"
    "is_retryable boolean, execution_time_ms bigint, created_at timestamp"
)
FEEDBACK = _schema(
    "id string, anomaly_id string, action string, comment string, previous_severity string,"
    "previous_confidence string, new_severity string, created_at timestamp"
)
EMBEDDINGS = _schema(
    "id string, template_id string, anomaly_id string, embedding floats, text_content string,"
    "created_at timestamp, expires_at timestamp"
)
RETENTION_RUNS = _schema(
    "id string, run_at timestamp, samples_deleted bigint, buckets_deleted bigint, anomalies_deleted bigint,"
    "analyses_deleted bigint, embeddings_deleted bigint, templates_deleted bigint, feedback_deleted bigint,"
    "status string"
)

# Strict total order of observations: every "first", "newest" and running count uses it.
OBSERVATION_ORDER = ("event_ts", "source_path", "line_number", "id")


# A stream's tables: sums per bucket with a sketch of clients, what each micro-batch met, and leases of triage runs.
BUCKET_LEDGER = _schema(
    "template_id string, application string, environment string, bucket_start timestamp, bucket_end timestamp, late boolean,"
    "count bigint, error_count bigint, clients binary"
)
BATCH_METRICS = _schema("batch bigint, watermark timestamp, seen_until timestamp, rows bigint, late_rows bigint")
LEASES = _schema("anomaly_id string, taken_at timestamp, lease_until timestamp")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns in contract order; columns the input lacks become typed nulls."""
    have = set(df.columns)

    def pick(field: T.StructField) -> Column:
        source = F.col(field.name) if field.name in have else F.lit(None)
        return source.cast(field.dataType).alias(field.name)

    return df.select(*[pick(field) for field in schema.fields])

"""Bodies that log shippers send, as a table or stream of JSON texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternlog.functions.parsing import strict_variant, strip

# Origins used when a body and its request name none.
DEFAULT_APPLICATION = "default-app"
ARRAY_APPLICATION = "fluent-bit"
DEFAULT_SOURCE = "http-ingest"
INGEST_PATH = "http://api/logs/ingest"


def _filled(*values: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.when(value != "", value) for value in values])


def _normalize(bodies: DataFrame, environment: str) -> DataFrame:
    have = set(bodies.columns)
    asked = {n: F.col(n) if n in have else F.lit(None).cast("string") for n in ("application", "environment", "source_name")}
    body = F.col("body")
    kind = F.schema_of_variant(strict_variant(body))
    at = lambda path: F.get_json_object(body, path)
    batch = kind.startswith("OBJECT") & F.schema_of_variant(
        F.try_variant_get(F.try_parse_json(body), "$.logs", "variant")
    ).startswith("ARRAY")
    shape = (
        F.when(kind.isNull(), "invalid")
        .when(batch, "batch")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .otherwise("invalid")
    )
    keys = F.json_object_keys(body)
    given = lambda name: F.when(F.array_contains(keys, name), at(f"$.{name}")).otherwise(asked[name])
    shaped = bodies.select(
        *[c for c in bodies.columns if c not in asked],
        *[value.alias(f"_{name}") for name, value in asked.items()],
        shape.alias("shape"),
        kind.alias("_kind"),
    )
    asked = {name: F.col(f"_{name}") for name in asked}
    of = lambda name: F.col("shape") == name
    application = (
        F.when(of("batch"), given("application"))
        .when(of("object"), _filled(at("$.application"), at("$.app"), asked["application"], F.lit(DEFAULT_APPLICATION)))
        .otherwise(
            _filled(
                asked["application"], at("$[0].application"), at("$[0].app"),
                F.when(F.substring(strip(F.get(F.from_json(body, "array<string>"), F.lit(0))), 1, 1) == "{", ARRAY_APPLICATION),
                F.lit(DEFAULT_APPLICATION),
            )
        )
    )
    environment_ = (
        F.when(of("batch"), given("environment"))
        .when(of("object"), _filled(at("$.environment"), at("$.env"), asked["environment"], F.lit(environment)))
        .otherwise(_filled(asked["environment"], at("$[0].environment"), at("$[0].env"), F.lit(environment)))
    )
    source = _filled(F.when(~of("array"), at("$.source_name")), asked["source_name"], F.lit(DEFAULT_SOURCE))
    items = (
        F.when(of("batch"), F.from_json(body, "struct<logs:array<string>>")["logs"])
        .when(of("object"), F.array(strip(body)))
        .when(of("array"), F.from_json(body, "array<string>"))
    )
    return shaped.select(
        *[c for c in shaped.columns if not c.startswith("_")],
        strip(application).alias("application"),
        strip(environment_).alias("environment"),
        source.alias("source_name"),
        items.alias("items"),
        F.when(of("invalid") & F.col("_kind").isNull(), "invalid_json").when(of("invalid"), "not_object_or_array").alias("reason"),
    ).withColumn(
        "reason",
        F.when(F.col("reason").isNotNull(), F.col("reason")).when(
            of("batch")
            & ((F.coalesce("application", F.lit("")) == "") | (F.coalesce("environment", F.lit("")) == "")),
            F.lit("application_and_environment_required"),
        ),
    )


def normalize_envelopes(
    bodies: DataFrame, environment: str = "production", ingest_ts: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """JSON bodies (``body`` and optional request defaults) to raw lines, and the rejected bodies.

    Three shapes are accepted: an object with a ``logs`` list, a list of entries, and a single entry. Objects
    among the entries stay JSON text. Blank entries are skipped, but count for the line numbers. Each entry is a record by
    itself, and the path names its body, by the column ``body_id`` or else by the body's digest; equal bodies without such a
    column count as one. ``ingest_ts`` is that of the body, or the time of the run for a table without it.
    """
    named = F.col("body_id").cast("string") if "body_id" in bodies.columns else F.sha2("body", 256)
    bodies = bodies.withColumn("_body_key", named)
    if "ingest_ts" not in bodies.columns:
        bodies = bodies.withColumn("ingest_ts", F.lit(ingest_ts).cast("timestamp") if ingest_ts else F.current_timestamp())
    shaped = _normalize(bodies.withColumnRenamed("_body_key", "body_key"), environment)
    rejected = shaped.where(F.col("reason").isNotNull()).drop("items", "application", "environment", "source_name", "body_key")
    rest = [c for c in shaped.columns if c not in ("items", "reason", "body", "shape")]
    lines = (
        shaped.where(F.col("reason").isNull())
        .select(*rest, F.posexplode("items").alias("_pos", "line"))
        .where(strip(F.col("line")) != "")
        .withColumn("line_number", (F.col("_pos") + 1).cast("bigint"))
        .withColumn("source_id", F.concat_ws("-", F.lit("ingest"), "application", "environment"))
        .withColumn("source_path", F.concat_ws("/", F.lit(INGEST_PATH), "body_key"))
        .withColumn("whole", F.lit(True))
        .drop("_pos", "body_key")
    )
    return lines, rejected

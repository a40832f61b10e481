"""Job ``mine_templates``: sanitized events in, observations and the template dictionary out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternlog.functions import masks
from lanternlog.functions.binding import bind
from lanternlog.functions.ids import row_id, template_id
from lanternlog.operators.ranking import first_rows
from lanternlog.schemas import OBSERVATION_ORDER, OBSERVATIONS, conform


def mask_templates(events: DataFrame, message: str = "sanitized_message") -> DataFrame:
    """Add ``template_text`` and ``template_id``: the masked first line is the template. No shuffle."""
    masked = masks.with_masks(events, message, "template_text")
    return masked.withColumn("template_id", template_id(F.col("template_text"), F.col("application"), F.col("environment")))


def extract_parameters(template: Column, message: Column) -> Column:
    """The parts of the message's first line that stand where the template has a mask or wildcard.

    The fixed parts of the template are looked up from left to right and each value ends where the next
    fixed part begins, so one pass is enough and nothing is tried twice.
    """
    places = bind(template, lambda text: F.split(text, masks.PLACEHOLDER, -1))
    return bind(masks.first_line(message), lambda line: bind(places, lambda fixed: _values(fixed, line)))


def _values(fixed: Column, line: Column) -> Column:
    """Values between the fixed parts of a template; none if the line does not fit."""
    none = F.array().cast("array<string>")
    start = F.struct(
        (F.length(F.get(fixed, F.lit(0))) + 1).cast("int").alias("at"),
        none.alias("values"),
        line.startswith(F.get(fixed, F.lit(0))).alias("ok"),
    )
    numbered = F.transform(fixed, lambda part, i: F.struct(part.alias("part"), (i == F.size(fixed) - 1).alias("last")))

    def end_of(state: Column, piece: Column) -> Column:
        """Where a value ends: an inner one has at least one character, the last one runs to the closing part."""
        inner = F.when(piece["part"] == "", state["at"] + 1).otherwise(F.position(piece["part"], line, state["at"] + 1))
        return F.when(piece["last"], F.length(line) - F.length(piece["part"]) + 1).otherwise(inner)

    def take(state: Column, piece: Column, end: Column) -> Column:
        good = (end > state["at"]) & (~piece["last"] | line.endswith(piece["part"]))
        taken = F.struct(
            (end + F.length(piece["part"])).cast("int").alias("at"),
            F.array_append(state["values"], F.substr(line, state["at"], end - state["at"])).alias("values"),
            F.lit(True).alias("ok"),
        )
        failed = F.struct(state["at"].alias("at"), state["values"].alias("values"), F.lit(False).alias("ok"))
        return F.when(good, taken).otherwise(failed)

    def step(state: Column, piece: Column) -> Column:
        taken = bind(end_of(state, piece), lambda end: take(state, piece, end))
        return F.when(state["ok"], taken).otherwise(state)

    found = F.aggregate(
        F.slice(numbered, 2, F.greatest(F.size(fixed), F.lit(1))), start, step, lambda state: F.when(state["ok"], state["values"])
    )
    return F.when(F.size(fixed) > 1, F.coalesce(found, none)).otherwise(none)


def build_observations(events: DataFrame, with_parameters: bool = True) -> DataFrame:
    """Sanitized events to rows of the observation contract, templates by mask."""
    mined = mask_templates(events)
    values = (
        extract_parameters(F.col("template_text"), F.col("sanitized_message"))
        if with_parameters
        else F.array().cast("array<string>")
    )
    part = F.col("record_part") if "record_part" in mined.columns else F.lit(0)
    rows = mined.withColumn("parameters", values).withColumn(
        "id", row_id(F.col("source_id"), F.col("source_path"), F.col("line_number"), part, F.col("sample_hash"))
    )
    return conform(rows, OBSERVATIONS)


def template_catalog(observations: DataFrame) -> DataFrame:
    """One row per template: first and last sight, exact count, founding message.

    Counts are fixed-width hash aggregates; the founding rows come from ``first_rows``.
    """
    stats = observations.groupBy("template_id").agg(
        F.min("event_ts").alias("first_seen"),
        F.max("event_ts").alias("last_seen"),
        F.count(F.lit(1)).alias("total_count"),
    )
    columns = ("template_id", "application", "environment", "template_text", "sanitized_message", *OBSERVATION_ORDER)
    founding = first_rows(observations.select(*columns), ["template_id"], "event_ts", OBSERVATION_ORDER)
    return founding.drop("id").join(stats, "template_id").select(
        F.col("template_id").alias("id"),
        "application",
        "environment",
        F.col("template_text").alias("template_pattern"),
        "first_seen",
        "last_seen",
        "total_count",
        F.col("sanitized_message").alias("sample_message"),
    )


def flag_new_templates(observations: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """First observation of every template that the known dictionary (column ``id``) lacks."""
    # One row per template is left before the dictionary is looked at, so no template's rows meet in one task.
    first = first_rows(observations, ["template_id"], "event_ts", OBSERVATION_ORDER).select(*observations.columns)
    if known is None:
        return first
    return first.join(known.select(F.col("id").alias("template_id")).distinct(), "template_id", "left_anti")


def top_templates(catalog: DataFrame, limit: int = 100) -> DataFrame:
    return catalog.orderBy(F.desc("total_count"), "id").limit(limit)

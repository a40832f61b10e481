"""How templates change: versions of their patterns with the rules that made them, and the sources they come from."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternlog.operators.ranking import lookup_join
from lanternlog.schemas import TEMPLATE_VERSIONS, conform


def rules_version(**rules: object) -> str:
    """Short name of the settings that templates were made with; equal settings have equal names."""
    return hashlib.sha256(json.dumps(rules, sort_keys=True, default=str).encode()).hexdigest()[:12]


def new_versions(catalog: DataFrame, versions: DataFrame | None = None, rules: str = "") -> DataFrame:
    """Rows that a run with the templates ``catalog`` adds to the table ``versions``.

    A template gets a further version if its pattern or the rules differ from those of its newest one; it holds from the first
    event of the template in this run. A repeated run adds nothing.
    """
    runs = catalog.withColumn("rules", F.lit(rules))
    if versions is None:
        changed = runs.withColumn("version", F.lit(1).cast("bigint"))
    else:
        newest = versions.groupBy(F.col("template_id").alias("id")).agg(
            F.max_by(F.struct("version", F.col("template_pattern").alias("pattern"), F.col("rules").alias("by")), "version").alias("_last")
        )
        last = F.col("_last")
        same = (last["pattern"] == F.col("template_pattern")) & (last["by"] == F.col("rules"))
        changed = runs.join(newest, "id", "left").where(~F.coalesce(same, F.lit(False))).withColumn(
            "version", F.coalesce(last["version"], F.lit(0)) + 1
        )
    return conform(
        changed.withColumnRenamed("id", "template_id").withColumnRenamed("first_seen", "valid_from"), TEMPLATE_VERSIONS
    )


def with_pattern_at(observations: DataFrame, versions: DataFrame, ts: str = "event_ts") -> DataFrame:
    """Add ``version`` and ``pattern``: the newest of the template that held at the time of the row, else its first.

    The versions of a template are one short list, since each widening takes a word from its pattern, so rows are not multiplied;
    a template with a large share of the rows is dealt out. Both columns are null for templates without versions. Observations
    have a template id by contract; rows without one are left out.
    """
    known = F.array_sort(F.collect_list(F.struct("version", "valid_from", F.col("template_pattern").alias("pattern"))))
    lists = versions.groupBy("template_id").agg(known.alias("_versions"))
    counts = observations.groupBy("template_id").agg(F.count(F.lit(1)).alias("_rows"))
    held = lookup_join(
        observations, counts.join(lists, "template_id", "left"), ["template_id"], "_rows", ["source_path", "line_number"]
    )
    begun = F.filter("_versions", lambda v: v["valid_from"] <= F.col(ts))
    at = F.coalesce(F.get(begun, F.size(begun) - 1), F.get("_versions", 0))
    return held.withColumn("_at", at).select(
        *observations.columns, F.col("_at.version").alias("version"), F.col("_at.pattern").alias("pattern")
    )


def template_sources(observations: DataFrame) -> DataFrame:
    """First and last event and number of rows of each template in each source."""
    return observations.groupBy("template_id", "application", "environment", "source_id").agg(
        F.min("event_ts").alias("first_seen"), F.max("event_ts").alias("last_seen"), F.count(F.lit(1)).alias("count")
    )

"""The jobs of the pipeline, chained from raw lines to verdicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternlog.functions.ids import DEFAULT_SALT, row_id
from lanternlog.operators import buckets as bk
from lanternlog.operators import clustering, detection, records, sanitize, templates, triage, versions
from lanternlog.operators.templates import extract_parameters
from lanternlog.schemas import OBSERVATIONS, conform
from lanternlog.session import materialize, stored


@dataclass(frozen=True)
class PipelineTables:
    """Results of a run."""

    observations: DataFrame
    templates: DataFrame
    buckets: DataFrame
    samples: DataFrame
    anomalies: DataFrame
    analyses: DataFrame
    #: Rows to append to the table of template versions.
    changes: DataFrame


def lines_to_events(lines: DataFrame, multiline: bool = True, log_format: str | None = None) -> DataFrame:
    """Raw lines to parsed events. Only the assembly of multiline records shuffles.

    Lines that carry the settings of their source (``multiline_pattern``, ``multiline_negate``, ``format``) are read by them.
    """
    full = records.drop_blank_lines(lines)
    if log_format is None and "format" in lines.columns:
        log_format = "format"
    if multiline and "multiline_pattern" in lines.columns:
        negate = F.col("multiline_negate") if "multiline_negate" in lines.columns else True
        assembled = records.assemble_multiline(full, pattern=F.col("multiline_pattern"), negate=negate)
    elif multiline:
        assembled = records.assemble_multiline(full)
    else:
        assembled = full.withColumn("record", F.col("line")).withColumn("record_part", F.lit(0))
    return records.fallback_event_time(records.parse_records(assembled, log_format=log_format))


def lines_to_observations(
    lines: DataFrame,
    multiline: bool = True,
    mode: str = "masked",
    salt: str = DEFAULT_SALT,
    known: DataFrame | None = None,
) -> DataFrame:
    """Raw lines to observations, templates by mask (``masked``) or by clustering (``drain``).

    Clustering goes on from the templates ``known`` from earlier runs.
    """
    sanitized = sanitize.sanitize_events(lines_to_events(lines, multiline), salt)
    if mode == "masked":
        return templates.build_observations(sanitized)
    mined = clustering.mine_templates(sanitized, known=known)
    rows = mined.withColumn(
        "parameters", extract_parameters(F.col("template_text"), F.col("sanitized_message"))
    ).withColumn(
        "id", row_id(F.col("source_id"), F.col("source_path"), F.col("line_number"), F.col("record_part"), F.col("sample_hash"))
    )
    return conform(rows, OBSERVATIONS)


def run_pipeline(
    lines: DataFrame,
    known: DataFrame | None = None,
    limits: detection.Thresholds = detection.Thresholds(),
    multiline: bool = True,
    mode: str = "masked",
    history: DataFrame | None = None,
) -> PipelineTables:
    """All tables that follow from raw lines; ``history`` is the table of template versions of earlier runs.

    The observations are stored once as Parquet, so that each of the other tables reads only the columns it needs; bucket
    counts are made once.
    """
    dictionary = known if known is not None and "template_pattern" in known.columns else None
    observations = stored(lines_to_observations(lines, multiline, mode, known=dictionary), "observations")
    samples = bk.samples(observations)
    counts = materialize(bk.bucket_counts(observations, limits.bucket_minutes))
    anomalies = detection.detect(observations, known, samples, limits, buckets=counts)
    catalog = templates.template_catalog(observations)
    return PipelineTables(
        observations=observations,
        templates=catalog,
        buckets=bk.rollup(observations, limits.bucket_minutes),
        samples=samples,
        anomalies=anomalies,
        analyses=triage.heuristic_triage(anomalies),
        changes=versions.new_versions(catalog, history, versions.rules_version(mode=mode)),
    )

"""Registered queries: every operator over the whole provided tables."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternlog.functions import masks, redaction
from lanternlog.operators import buckets as bk
from lanternlog.operators import clustering, correlation, incidents, kpis, memory, merges, records, retention
from lanternlog.operators import detection as dt
from lanternlog.operators import sanitize, templates, triage, vector_lists, versions
from lanternlog.plans import jobs, views
from lanternlog.schemas import ANALYSES, FEEDBACK, OBSERVATIONS, conform
from lanternlog.session import materialize, new_path
from lanternlog.sources import catalog, cloudwatch, containers, envelopes, files, kafka
from lanternlog.streaming import detection as stream_detection
from lanternlog.streaming import metrics as stream_metrics_of
from lanternlog.streaming import observations as stream_obs
from lanternlog.streaming import rollup as stream_rollup
from lanternlog.streaming import triage as triage_stream

Query = Callable[[SparkSession, str], DataFrame]
HOURLY = dt.Thresholds(bucket_minutes=60)
# The end of the provided events, as the time of a retention run.
NOW = datetime(2024, 1, 31)
# How long the retention queries keep samples and evidence.
KEEP_HOURS = 480
# The event tables are split here into an older and a newer part.
SPLIT = "2024-01-20"


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as text and times without zone, so that results compare across engines."""

    def plain(field: T.StructField) -> Column:
        column = F.col(field.name)
        if isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StringType):
            column = F.array_join(column, " | ")
        elif isinstance(field.dataType, T.MapType):
            entries = F.array_sort(F.map_entries(column))
            column = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
        return column.alias(field.name)

    return df.select(*[plain(field) for field in df.schema.fields])


REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register a query under its own name."""
    REGISTRY[function.__name__] = lambda spark, sf_dir: flat(function(spark, sf_dir))
    return function


# --- inputs that several queries share -------------------------------------------------------------------


def _dense(spark: SparkSession, sf: str) -> DataFrame:
    return views.event_observations(spark, sf, scoped=False)


def _incidents(spark: SparkSession, sf: str) -> DataFrame:
    """Anomalies of the dense events in hourly buckets."""
    observations = _dense(spark, sf)
    return materialize(dt.detect(observations, samples=bk.samples(observations), limits=HOURLY))


def _verdicts(found: DataFrame) -> DataFrame:
    """Zero to two verdicts per incident, by its id; the second one is newer and may have failed."""
    digit = F.conv(F.substring("id", 1, 1), 16, 10).cast("int")
    many = found.where(digit % 3 > 0).select("*", F.explode(F.sequence(F.lit(1), digit % 3)).alias("_try"))
    severity = F.concat(F.lit("Sev-"), ((digit + F.col("_try")) % 5).cast("string"))
    rows = many.select(
        F.concat_ws("-", F.col("id"), F.col("_try").cast("string")).alias("id"),
        F.col("id").alias("anomaly_id"),
        F.lit("model-a").alias("model"),
        F.lit("v2.0").alias("prompt_version"),
        severity.alias("severity"),
        F.lit("medium").alias("confidence"),
        (severity != "Sev-4").alias("investigate"),
        F.concat(F.lit("try "), F.col("_try").cast("string"), F.lit(" of "), F.col("template_text")).alias("summary"),
        F.array(F.lit("look"), F.col("template_text")).alias("recommended_actions"),
        F.array(F.lit("cause")).alias("possible_causes"),
        F.when((F.col("_try") == 2) & (digit % 2 == 0), F.lit("timeout")).alias("error"),
        ((F.col("_try") == 2) & (digit % 2 == 0)).alias("is_retryable"),
        (F.col("detected_at") + F.make_dt_interval(mins=F.col("_try"))).alias("created_at"),
    )
    return conform(rows, ANALYSES)


def _feedback(spark: SparkSession, sf: str, found: DataFrame) -> DataFrame:
    """Labels as operator actions on the incident with the label's number."""
    number = F.substring("incident_number", 4, 20).cast("bigint")
    action = F.when(F.col("quality") == 1, "resolved").when(F.col("toxic") == 1, "false_positive").otherwise("transient")
    rows = (
        views.table(spark, sf, "labels")
        .join(found.select(F.col("id").alias("anomaly_id"), "template_text", "detected_at", number.alias("doc_id")), "doc_id")
        .select(
            F.concat(F.lit("fb-"), F.col("doc_id").cast("string")).alias("id"),
            "anomaly_id",
            action.alias("action"),
            F.concat(F.lit("restarted "), F.col("template_text"), F.lit(" worker "), (F.col("doc_id") % 5).cast("string")).alias("comment"),
            (F.col("detected_at") + F.make_dt_interval(hours=F.lit(1))).alias("created_at"),
        )
    )
    return conform(rows, FEEDBACK)


def _records_of(spark: SparkSession, sf: str) -> DataFrame:
    return records.assemble_multiline(views.multiline_lines(spark, sf))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return records.fallback_event_time(records.parse_records(_records_of(spark, sf)))


def _document_events(spark: SparkSession, sf: str) -> DataFrame:
    lines = records.drop_blank_lines(views.document_lines(spark, sf))
    named = lines.withColumn("record", F.col("line")).withColumn("record_part", F.lit(0))
    return records.fallback_event_time(records.parse_records(named))


# --- rollup ------------------------------------------------------------------------------------------------


@query
def bucket_timeline(spark, sf):
    return bk.bucket_timeline(bk.bucket_counts(views.event_observations(spark, sf)))


@query
def bucket_counts(spark, sf):
    return bk.bucket_counts(views.event_observations(spark, sf))


@query
def bucket_samples(spark, sf):
    return bk.bucket_samples(_dense(spark, sf), 60)


@query
def bucket_rollup(spark, sf):
    return bk.rollup(_dense(spark, sf), 60)


@query
def bucket_severity(spark, sf):
    return bk.bucket_severity_counts(views.event_observations(spark, sf), 60)


@query
def bucket_clients(spark, sf):
    return bk.bucket_client_cardinality(views.event_observations(spark, sf), 60)


@query
def bucket_sources(spark, sf):
    return bk.bucket_source_refs(views.event_observations(spark, sf), 60)


@query
def template_totals(spark, sf):
    return bk.template_totals(bk.bucket_counts(views.event_observations(spark, sf)))


@query
def baseline_zscore(spark, sf):
    scored = dt.score_buckets(bk.bucket_counts(_dense(spark, sf), 60), HOURLY)
    numbers = [F.round(c, 6).alias(c) for c in ("baseline_mean", "baseline_std", "z_score")]
    return scored.select("template_id", "bucket_start", "count", "baseline_buckets", *numbers)


@query
def running_bucket_count(spark, sf):
    counted = bk.running_bucket_count(_dense(spark, sf), 60)
    return counted.select("id", "template_id", "bucket_start", "running_count")


@query
def recent_buckets(spark, sf):
    recent = bk.recent_buckets(bk.bucket_counts(views.event_observations(spark, sf)))
    return recent.select("template_id", "bucket_start", "count", "error_count", "rank")


@query
def samples(spark, sf):
    return bk.samples(views.event_observations(spark, sf))


@query
def recent_samples(spark, sf):
    recent = bk.recent_samples(bk.samples(views.event_observations(spark, sf)))
    return recent.select("template_id", "sample_hash", "sanitized_message", "event_ts", "rank")


# --- parsing -----------------------------------------------------------------------------------------------


@query
def assemble_multiline(spark, sf):
    return _records_of(spark, sf).select("source_path", "line_number", "record", "line_count")


@query
def parse_events(spark, sf):
    return _events(spark, sf).select("source_path", "line_number", "event_ts", "level", "message", "attributes")


@query
def enrich_lines(spark, sf):
    """Lines with the configuration of their source, production sources only."""
    lines = views.event_lines(spark, sf)
    sources = lines.where(F.col("environment") == "production").select(
        F.col("source_id").alias("id"), F.concat(F.lit("svc-"), "application").alias("service"), F.lit("auto").alias("format")
    ).distinct()
    return records.enrich_from_sources(lines, sources).select("source_path", "line_number", "service", "format")


@query
def parse_documents(spark, sf):
    return _document_events(spark, sf).select("source_path", "line_number", "event_ts", "level", "message", "has_time")


@query
def parse_quality(spark, sf):
    """Event records, event lines of which every fifth is broken, and document lines, which have no time."""
    broken = records.fallback_event_time(records.parse_records(_broken_lines(spark, sf)))
    keep = ("application", "environment", "record", "attributes", "has_time", "level")
    events, broken, texts = (df.select(*keep) for df in (_events(spark, sf), broken, _document_events(spark, sf)))
    return records.parse_quality(events.unionByName(broken).unionByName(texts))


def _broken_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Event lines as records, every fifth one cut short."""
    cut = F.when(F.col("line_number") % 5 == 0, F.concat(F.substring_index("line", ":", 3), F.lit("}"))).otherwise(F.col("line"))
    return views.event_lines(spark, sf).withColumn("record", cut)


@query
def quarantine(spark, sf):
    """Event lines of which every fifth is cut short: broken JSON must be set aside."""
    return records.quarantine(_broken_lines(spark, sf)).select("source_path", "line_number", "record", "reason")


# --- redaction ---------------------------------------------------------------------------------------------


@query
def redact_documents(spark, sf):
    clean = sanitize.sanitize_events(_document_events(spark, sf))
    return clean.select("source_path", "line_number", "sanitized_message", "redaction_types", "sample_hash")


@query
def redact_events(spark, sf):
    clean = sanitize.sanitize_events(_events(spark, sf))
    return clean.select("source_path", "line_number", "sanitized_message", "redaction_types", "sample_hash")


@query
def redact_pages(spark, sf):
    pages = views.spread(views.table(spark, sf, "pages"), views.TEXT_ROWS).select("page_id", "html")
    return redaction.with_redaction(pages, "html", "sanitized").select("page_id", "sanitized", "redaction_types")


@query
def redaction_audit(spark, sf):
    both = sanitize.sanitize_events(_document_events(spark, sf)).unionByName(
        sanitize.sanitize_events(_events(spark, sf)), allowMissingColumns=True
    )
    return sanitize.redaction_audit(both)


@query
def sanitize_attributes(spark, sf):
    lines = _events(spark, sf).withColumn("source_name", F.lit("shipper"))
    clean = sanitize.sanitize_events(lines.withColumn("service", F.lit("from-source")))
    return clean.select("source_path", "line_number", "client_id_hash", "metadata")


def _secret_events(spark: SparkSession, sf: str) -> DataFrame:
    named = views.secret_lines(spark, sf).withColumn("record", F.col("line")).withColumn("record_part", F.lit(0))
    return sanitize.sanitize_events(records.fallback_event_time(records.parse_records(named)))


@query
def redact_secrets(spark, sf):
    """Event lines with values of all kinds that rules remove."""
    return _secret_events(spark, sf).select("source_path", "line_number", "sanitized_message", "redaction_types", "sample_hash")


@query
def mask_secrets(spark, sf):
    return templates.mask_templates(_secret_events(spark, sf)).select("source_path", "line_number", "template_text", "template_id")


# --- templates ---------------------------------------------------------------------------------------------


@query
def mask_events(spark, sf):
    clean = sanitize.sanitize_events(_events(spark, sf))
    return templates.mask_templates(clean).select("source_path", "line_number", "template_text", "template_id")


@query
def mask_documents(spark, sf):
    clean = sanitize.sanitize_events(_document_events(spark, sf))
    return templates.mask_templates(clean).select("source_path", "line_number", "template_text", "template_id")


@query
def observations(spark, sf):
    rows = jobs.lines_to_observations(views.multiline_lines(spark, sf))
    return rows.drop("parameters", "metadata", "redaction_types")


@query
def extract_parameters(spark, sf):
    rows = jobs.lines_to_observations(views.multiline_lines(spark, sf))
    return rows.select("source_path", "line_number", "template_text", "parameters")


@query
def template_catalog(spark, sf):
    return templates.template_catalog(views.event_observations(spark, sf))


@query
def document_templates(spark, sf):
    """Catalogue of the document lines: most templates here occur once."""
    clean = sanitize.sanitize_events(_document_events(spark, sf))
    return templates.template_catalog(materialize(templates.build_observations(clean, with_parameters=False)))


@query
def top_templates(spark, sf):
    return templates.top_templates(templates.template_catalog(views.event_observations(spark, sf)), 20)


@query
def new_templates(spark, sf):
    """First sights after the split date of templates unknown before it."""
    seen = views.event_observations(spark, sf)
    extended = seen.withColumn("template_id", F.concat_ws("-", "template_id", F.substring("sample_hash", 1, 2)))
    old = extended.where(F.col("event_ts") < SPLIT).select(F.col("template_id").alias("id"))
    new = extended.where(F.col("event_ts") >= SPLIT)
    return templates.flag_new_templates(new, old).select("template_id", "id", "event_ts", "sanitized_message")


@query
def mine_templates_drain(spark, sf):
    clean = sanitize.sanitize_events(_events(spark, sf))
    mined = clustering.mine_templates(clean)
    return mined.groupBy("application", "environment", "template_id", "template_text").agg(F.count(F.lit(1)).alias("rows"))


@query
def mine_documents_drain(spark, sf):
    clean = sanitize.sanitize_events(_document_events(spark, sf))
    mined = clustering.mine_templates(clean, keep=[])
    return mined.groupBy("application", "environment", "template_id", "template_text").agg(F.count(F.lit(1)).alias("rows"))


def _fits(text: str, pattern: str) -> Column:
    """Whether a masked line has the words of a template, wherever that has no wildcard."""
    words = lambda c: F.filter(F.split(c, " +"), lambda w: w != "")
    same = F.zip_with(words(text), words(pattern), lambda a, b: (b == clustering.WILDCARD) | (a == b))
    fits = (F.size(words(text)) == F.size(words(pattern))) & F.forall(same, lambda ok: ok)
    equal = F.col(text) == F.col(pattern)
    return F.when(equal, True).otherwise(fits)


@query
def mined_documents_fit(spark, sf):
    """Per scope: lines, lines whose masked text fits their template, and template ids beyond one per template text."""
    clean = sanitize.sanitize_events(_document_events(spark, sf))
    mined = clustering.mine_templates(masks.with_masks(clean, "sanitized_message", "masked"), keep=["masked"])
    return mined.groupBy("application", "environment").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(_fits("masked", "template_text")).alias("fitting"),
        (F.count_distinct("template_id") - F.count_distinct("template_text")).alias("ids_over_texts"),
    )


@query
def mined_across_runs(spark, sf):
    """Templates of the newer events, mined on top of the dictionary of the older ones.

    Per scope: events, events whose masked line fits their template, and events with an id that earlier runs gave to a
    template they do not fit.
    """
    clean = sanitize.sanitize_events(_events(spark, sf))
    old = clustering.mine_templates(clean.where(F.col("event_ts") < SPLIT))
    known = materialize(
        old.groupBy(F.col("template_id").alias("id"), "application", "environment").agg(
            F.min("template_text").alias("template_pattern"), F.min("event_ts").alias("first_seen")
        )
    )
    new = clustering.mine_templates(clean.where(F.col("event_ts") >= SPLIT), known=known)
    masked = masks.with_masks(new, "sanitized_message", "masked").join(
        known.select(F.col("id").alias("template_id"), F.col("template_pattern").alias("earlier")), "template_id", "left"
    )
    return masked.groupBy("application", "environment").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(_fits("masked", "template_text")).alias("fitting"),
        F.count_if(~_fits("earlier", "template_text")).alias("misnamed"),
    )


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Observations of three runs, ten days each and the rest; later runs have widened some patterns."""
    run = F.least(F.floor(F.datediff("event_ts", F.lit("2024-01-01")) / 10), F.lit(2))
    text = F.col("template_text")
    wide = F.when((run >= 1) & F.col("application").isin("app-1", "app-3"), F.replace(text, F.lit("<NUM>"), F.lit("<*>"))).otherwise(text)
    wider = F.when((run >= 2) & (F.col("environment") == "production"), F.replace(wide, F.lit("request"), F.lit("<*>"))).otherwise(wide)
    return views.event_observations(spark, sf).withColumn("run", run).withColumn("template_text", wider)


def _versions_of(runs: DataFrame) -> DataFrame:
    """The table of versions after the runs, the second of which is repeated."""
    table = None
    for number in (0, 1, 1, 2):
        catalog = templates.template_catalog(runs.where(F.col("run") == number).drop("run"))
        added = versions.new_versions(catalog, table, versions.rules_version(similarity=0.5, depth=4))
        table = materialize(added if table is None else table.unionByName(added))
    return table


@query
def template_versions(spark, sf):
    return _versions_of(_runs(spark, sf)).drop("rules")


@query
def patterns_at_event_time(spark, sf):
    """Events by the version of their template that held when they were written."""
    runs = _runs(spark, sf)
    rows = versions.with_pattern_at(runs, _versions_of(runs))
    return rows.groupBy("template_id", "version", "pattern").agg(
        F.count(F.lit(1)).alias("events"), F.min("event_ts").alias("first_event"), F.max("event_ts").alias("last_event")
    )


@query
def template_sources(spark, sf):
    return versions.template_sources(views.event_observations(spark, sf))


# --- detection ---------------------------------------------------------------------------------------------


def _slim(anomalies: DataFrame) -> DataFrame:
    return anomalies.select(
        "id", "anomaly_type", "template_id", "bucket_start", "detected_at", "current_count", "baseline_count", "z_score",
        "template_text", "sample_evidence", "source_paths",
        F.col("evidence_references")[0]["line_number"].alias("line_number"),
    )


@query
def detect_new_templates(spark, sf):
    return _slim(dt.detect_new_templates(views.event_observations(spark, sf)))


@query
def frequency_spikes(spark, sf):
    seen = _dense(spark, sf)
    return _slim(dt.detect_frequency_spikes(seen, samples=bk.samples(seen), limits=HOURLY))


@query
def error_bursts(spark, sf):
    seen = _dense(spark, sf)
    return _slim(dt.detect_error_bursts(seen, samples=bk.samples(seen), limits=HOURLY))


@query
def anomalies(spark, sf):
    found = dt.detect(_dense(spark, sf), limits=HOURLY)
    return found.select("id", "incident_number", "anomaly_type", "template_id", "bucket_start", "current_count", "status")


@query
def warning_bursts(spark, sf):
    found = dt.detect_level_bursts(_dense(spark, sf), limits=HOURLY)
    return found.select("template_id", "bucket_start", "count", F.round("z_score", 4).alias("z_score"), "trigger_count")


@query
def cap_batches(spark, sf):
    capped = dt.cap_batches(_incidents(spark, sf), size=3, seconds=86_400)
    return capped.select("id", "batch_start", "in_batch", "status")


@query
def correlated_anomalies(spark, sf):
    """New-template anomalies of the scoped events, whose applications write different files."""
    found = dt.detect_new_templates(_by_file(spark, sf))
    return correlation.correlate_anomalies(found, minutes=60)


def _by_file(spark: SparkSession, sf: str) -> DataFrame:
    """Scoped events under one application name, so that its files differ."""
    seen = views.event_observations(spark, sf)
    return seen.withColumn("application", F.lit("all")).withColumn(
        "template_id", F.concat_ws("-", "template_id", F.substring("sample_hash", 1, 1))
    )


@query
def correlation_members(spark, sf):
    found = materialize(dt.detect_new_templates(_by_file(spark, sf)))
    groups = correlation.correlate_anomalies(found, minutes=60)
    return correlation.correlation_members(found, groups, minutes=60).select("id", "group_id")


@query
def field_combinations(spark, sf):
    clean = sanitize.sanitize_events(_events(spark, sf))
    return correlation.unusual_field_combinations(clean, ("http_status", "service"), max_share=0.3)


@query
def template_combinations(spark, sf):
    found = correlation.unusual_template_combinations(_dense(spark, sf), minutes=60)
    return found.withColumn("share", F.round("share", 8))


@query
def template_pairs(spark, sf):
    """Classes of templates that appear together in hours of the same environment, from different files."""
    found = correlation.unusual_template_pairs(_by_file(spark, sf), minutes=60, min_together=3, min_lift=4.0)
    return found.withColumn("lift", F.round("lift", 8))


@query
def template_pair_classes(spark, sf):
    return correlation.template_classes(_by_file(spark, sf), minutes=60, min_together=3, min_lift=4.0)


# --- dashboards --------------------------------------------------------------------------------------------


_INCIDENT = ("id", "incident_number", "application", "status", "template_text", "detected_at", "current_count")


@query
def status_leased(spark, sf):
    """Statuses while triage runs: some incidents are held, some leases have ended, some were followed by a verdict."""
    found = _incidents(spark, sf)
    kind = F.ascii(F.right("id", F.lit(1))) % 4
    now = F.lit(NOW).cast("timestamp")
    runs = [(0, now - F.expr("INTERVAL 1 MINUTE")), (1, now - F.expr("INTERVAL 10 MINUTES")), (2, F.lit("2023-12-01"))]
    leases = [triage.take_leases(found.where(kind == k), taken) for k, taken in runs]
    held = leases[0].unionByName(leases[1]).unionByName(leases[2])
    current = triage.status_lifecycle(found, _verdicts(found), _feedback(spark, sf, found), held, now)
    waiting = triage.unfinished(found, _verdicts(found), held, now).select("id", F.lit(True).alias("waiting"))
    return current.join(waiting, "id", "left").select("id", "status", F.coalesce("waiting", F.lit(False)).alias("waiting"))


def _statuses(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    found = _incidents(spark, sf)
    verdicts, actions = _verdicts(found), _feedback(spark, sf, found)
    return triage.status_lifecycle(found, verdicts, actions), verdicts, actions


@query
def status_lifecycle(spark, sf):
    return _statuses(spark, sf)[0].select("id", "incident_number", "status")


@query
def active_incidents(spark, sf):
    found, verdicts, _ = _statuses(spark, sf)
    rows = incidents.active_anomalies(found, verdicts)
    return rows.select(*_INCIDENT, "severity", "investigate", "summary", "recommended_actions", "ai_error", "is_retryable")


@query
def active_incidents_latest(spark, sf):
    found, verdicts, _ = _statuses(spark, sf)
    rows = incidents.active_anomalies(found, verdicts, latest_only=True)
    return rows.select(*_INCIDENT, "severity", "summary", "ai_error")


@query
def dismissed_incidents(spark, sf):
    found, verdicts, actions = _statuses(spark, sf)
    rows = incidents.dismissed_anomalies(found, actions, verdicts)
    return rows.select(*_INCIDENT, "dismissal_comment", "dismissal_action", "dismissed_at", "severity", "summary")


@query
def filter_incidents(spark, sf):
    found, verdicts, _ = _statuses(spark, sf)
    rows = incidents.active_anomalies(found, verdicts, latest_only=True)
    wanted = incidents.filter_incidents(rows, severity="Sev-2", environment="production", source="/logs/app.log")
    return wanted.select(*_INCIDENT, "severity")


@query
def template_detail(spark, sf):
    seen = views.event_observations(spark, sf)
    detail = incidents.template_detail(templates.template_catalog(seen), bk.bucket_counts(seen), bk.samples(seen))
    listed = lambda c, f: F.array_join(F.transform(c, f), ",")
    return detail.select(
        "template_id", "template_pattern", "total_count", "sample_message",
        listed("history", lambda h: h["count"].cast("string")).alias("history_counts"),
        listed("samples", lambda s: s["sample_hash"]).alias("sample_hashes"),
    )


@query
def related_incidents(spark, sf):
    found = _incidents(spark, sf).withColumn("batch_start", F.window("detected_at", "1 day")["start"])
    rows = incidents.related_anomalies(found, ("application", "environment", "batch_start"), limit=3)
    return rows.select("id", F.transform("related", lambda r: r["id"]).alias("related"))


@query
def recent_feedback(spark, sf):
    found = _incidents(spark, sf)
    rows = incidents.recent_feedback(_feedback(spark, sf, found))
    return rows.select("id", "anomaly_id", "action", "comment", "created_at")


@query
def telemetry(spark, sf):
    found, verdicts, _ = _statuses(spark, sf)
    seen = _dense(spark, sf)
    sources = seen.select("source_id").distinct()
    return kpis.telemetry_kpis(seen, found, templates.template_catalog(seen), sources, verdicts)


# --- merges and retention ----------------------------------------------------------------------------------


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Older and newer events; the day of the split is in both, as after a repeated delivery."""
    seen = views.event_observations(spark, sf)
    day_after = F.lit(SPLIT).cast("timestamp") + F.make_dt_interval(days=F.lit(1))
    return seen.where(F.col("event_ts") < day_after), seen.where(F.col("event_ts") >= F.lit(SPLIT).cast("timestamp"))


@query
def merge_templates(spark, sf):
    old, new = _halves(spark, sf)
    return merges.merge_templates(templates.template_catalog(old), templates.template_catalog(new))


@query
def merge_buckets(spark, sf):
    old, new = _halves(spark, sf)
    return merges.merge_buckets(bk.rollup(old, 60), bk.rollup(new, 60))


@query
def insert_samples(spark, sf):
    old, new = _halves(spark, sf)
    return merges.insert_samples(bk.samples(old), bk.samples(new))


@query
def insert_anomalies(spark, sf):
    found = _incidents(spark, sf)
    split = F.lit(SPLIT).cast("timestamp")
    stored = merges.insert_anomalies(found.where(F.col("detected_at") < split), found)
    return stored.select("id", "detected_at", F.size("sample_evidence").alias("samples"))


@query
def merge_analyses(spark, sf):
    found = _incidents(spark, sf)
    old = _verdicts(found)
    again = old.withColumn("severity", F.lit("Sev-0")).withColumn("created_at", F.col("created_at") + F.make_dt_interval(days=F.lit(1)))
    new = again.withColumn("raw_response", F.lit("text")).where(F.col("error").isNotNull()).withColumn("error", F.lit(None).cast("string"))
    return merges.merge_analyses(old, new).select("id", "anomaly_id", "severity", "error", "raw_response", "created_at")


@query
def apply_feedback(spark, sf):
    found = _incidents(spark, sf)
    return merges.apply_feedback(found, _feedback(spark, sf, found)).select("id", "incident_number", "status")


@query
def upsert_sources(spark, sf):
    """Sources of the older events, updated by those of the newer ones."""
    old, new = _halves(spark, sf)

    def config(rows: DataFrame, fmt: str) -> DataFrame:
        named = rows.groupBy(F.col("source_id").alias("id"), "application", "environment").agg(F.max("event_ts").alias("last_seen"))
        return named.withColumn("path", F.concat(F.lit("/logs/"), F.col("application"), F.lit(".log"))).withColumn(
            "format", F.lit(fmt)
        ).withColumn("enabled", F.lit(True))

    production = config(new.where(F.col("environment") == "production"), "json")
    return incidents.list_sources(
        merges.upsert_sources(config(old, "auto"), production, merges.sources_last_seen(new))
    )


def _tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    found, verdicts, actions = _statuses(spark, sf)
    seen = _dense(spark, sf)
    return {
        "samples": bk.samples(seen, hours=KEEP_HOURS),
        "buckets": bk.bucket_counts(seen, 60),
        "anomalies": found,
        "analyses": verdicts,
        "feedback": actions,
        "templates": templates.template_catalog(seen),
        "embeddings": memory.index_records(found, verdicts),
    }


@query
def retention_report(spark, sf):
    """A run whose windows end inside the provided events, so that part of every table expires."""
    tables = _tables(spark, sf)
    report = retention.retention_report(tables, datetime(2024, 2, 12), KEEP_HOURS, months=1)
    return report.drop("id")


@query
def retained_rows(spark, sf):
    """Rows, and rows with evidence or raw text, that each table keeps."""
    kept = retention.retain(_tables(spark, sf), datetime(2024, 2, 12), KEEP_HOURS, months=1)
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in kept.items()]
    evidence = kept["anomalies"].agg(F.count_if(F.size("sample_evidence") > 0).alias("rows"))
    union = evidence.select(F.lit("evidence").alias("name"), "rows")
    for part in counts:
        union = union.unionByName(part)
    return union


# --- memory and triage -------------------------------------------------------------------------------------


@query
def embed_documents(spark, sf):
    texts = views.spread(views.table(spark, sf, "documents").select("doc_id", "text"), views.TEXT_ROWS)
    embedded = memory.embed_text(texts, ["doc_id"], "text")
    filled = F.size(F.filter("embedding", lambda x: x > 0))
    top = F.array_max("embedding")
    return embedded.select(
        "doc_id", filled.alias("dimensions"), F.round(top.cast("double"), 5).alias("largest"),
        (F.array_position("embedding", top) - 1).alias("largest_at"),
    )


def _vector_queries(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every row whose id is divisible by 20, and all rows."""
    corpus = views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return corpus.where(F.col("id") % 20 == 0).withColumnRenamed("id", "query_id"), corpus


@query
def similar_vectors(spark, sf):
    asked, corpus = _vector_queries(spark, sf)
    return memory.search_similar(asked, corpus, self_match=False)


@query
def similar_vectors_pruned(spark, sf):
    """The same through inverted lists, leaving out those that cannot hold a match."""
    asked, corpus = _vector_queries(spark, sf)
    return vector_lists.search_exact(asked, vector_lists.build_lists(corpus), self_match=False)


@query
def similar_vectors_lsh(spark, sf):
    """The approximate search, by lists whose probes an audit has set."""
    asked, corpus = _vector_queries(spark, sf)
    lists = vector_lists.audited(asked, vector_lists.build_lists(corpus), self_match=False)
    return vector_lists.search_lists(asked, lists, self_match=False)


@query
def similar_vectors_recall(spark, sf):
    """Whether the approximate search finds nine tenths of the exact matches of all queries, and compares fewer pairs."""
    asked, corpus = _vector_queries(spark, sf)
    lists = vector_lists.audited(asked, vector_lists.build_lists(corpus), self_match=False)
    exact = memory.search_similar(asked, corpus, self_match=False).select("query_id", "id", F.lit(1).alias("exact"))
    found = vector_lists.search_lists(asked, lists, self_match=False).select("query_id", "id", F.lit(1).alias("found"))
    both = exact.join(found, ["query_id", "id"], "left")
    every = asked.count() * corpus.count()
    return both.agg(
        F.sum("exact").alias("matches"), (F.sum("found") >= 0.9 * F.sum("exact")).alias("recall_reached"),
        F.lit(vector_lists.compared_pairs(asked, lists) < every).alias("fewer_pairs"),
    )


def _memory(found: DataFrame, verdicts: DataFrame, actions: DataFrame) -> DataFrame:
    return materialize(
        memory.index_records(found, verdicts).unionByName(memory.index_resolutions(found, actions))
    )


@query
def index_records(spark, sf):
    found, verdicts, _ = _statuses(spark, sf)
    return memory.index_records(found, verdicts).select("id", "template_id", "anomaly_id", "text_content", "created_at")


@query
def index_resolutions(spark, sf):
    found, _, actions = _statuses(spark, sf)
    return memory.index_resolutions(found, actions).select("id", "anomaly_id", "text_content", "created_at")


@query
def similar_resolutions(spark, sf):
    found, verdicts, actions = _statuses(spark, sf)
    # Verdicts of the same templates outnumber the resolutions, so more matches than usual are looked through.
    rows = memory.search_resolutions(triage.template_queries(found), _memory(found, verdicts, actions), overfetch=40)
    return rows.select(F.col("query_id").alias("template_text"), "id", "score", "rank")


@query
def heuristic_triage(spark, sf):
    """Verdicts on every incident, with the places that their evidence names."""
    rows = triage.heuristic_triage(_incidents(spark, sf))
    place = lambda m: F.concat_ws(" ", m["template_id"], m["source_id"], m["source_path"], m["line_number"])
    return rows.select(
        "anomaly_id", "severity", "confidence", "investigate", "summary", "possible_causes", "recommended_actions",
        F.array_join(F.transform("evidence", place), " | ").alias("evidence"),
    )


@query
def recalled_triage(spark, sf):
    """Triage with a memory that holds nothing but resolutions."""
    found, _, actions = _statuses(spark, sf)
    known = materialize(memory.index_resolutions(found, actions))
    rows = triage.apply_past_resolutions(triage.heuristic_triage(found), found, known)
    return rows.select("anomaly_id", "severity", "summary", "recommended_actions")


@query
def triage_context(spark, sf):
    found, verdicts, actions = _statuses(spark, sf)
    rows = triage.triage_context(found, _memory(found, verdicts, actions), actions, batch_seconds=86_400)
    return rows.select("id", "evidence", "past_resolutions", "similar", "feedback", "batch")


def _answers(found: DataFrame) -> DataFrame:
    """Model answers in eight shapes, good and bad, by the first digit of the incident's id."""
    digit = F.conv(F.substring("id", 1, 1), 16, 10).cast("int") % 8
    head = F.concat(F.lit('{"severity": "Sev-'), (digit % 5).cast("string"), F.lit('", "summary": "'), F.col("template_text"), F.lit('"'))
    answer = (
        F.when(digit == 0, F.concat(head, F.lit(', "confidence": "high", "investigate": false, "evidence": [{"a": "b"}, 3], "possible_causes": ["x"], "recommended_actions": ["y", "z"], "limitations": "none"}')))
        .when(digit == 1, F.concat(head, F.lit(', "confidence": "certain", "limitations": ["l1", "", "l2"]}')))
        .when(digit == 2, F.lit("not json at all"))
        .when(digit == 3, F.lit('{"severity": "Sev-9", "possible_causes": "text"}'))
        .when(digit == 4, F.lit('{"severity": "Sev-9"}'))
        .when(digit == 5, F.lit('["list"]'))
        .when(digit == 6, F.concat(head, F.lit(', "investigate": 0, "evidence": []}')))
        .otherwise(F.concat(head, F.lit(', "confidence": "low", "recommended_actions": []}')))
    )
    return found.select(F.col("id").alias("anomaly_id"), F.lit("model-b").alias("model"), answer.alias("answer"))


@query
def validate_verdicts(spark, sf):
    found = _incidents(spark, sf)
    rows = triage.validate_verdicts(_answers(found), found)
    return rows.select(
        "anomaly_id", "model", "severity", "confidence", "investigate", "summary", F.size("evidence").alias("evidence"),
        "possible_causes", "recommended_actions", "limitations", "error", "is_retryable",
    )


@query
def ask_context(spark, sf):
    """Every turn of a user as a question about the incidents."""
    found, verdicts, actions = _statuses(spark, sf)
    turns = views.table(spark, sf, "conversations")
    questions = turns.where(F.col("role") == "user").select(F.concat_ws("/", "conv_id", "turn").alias("question_id"), "text")
    active = incidents.active_anomalies(found, verdicts, latest_only=True)
    return triage.ask_context(questions, _memory(found, verdicts, actions), active)


@query
def chat_window(spark, sf):
    return triage.chat_window(views.table(spark, sf, "conversations"), last=4, max_chars=200)


@query
def chat_window_full(spark, sf):
    return triage.chat_window(views.table(spark, sf, "conversations"))


# --- sources and sinks -------------------------------------------------------------------------------------


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Event lines in envelopes of ten, in five shapes."""
    lines = views.event_lines(spark, sf)
    number = F.floor(F.col("line_number") / 10)
    text = F.to_json(F.struct(F.col("line").alias("log")))
    grouped = lines.groupBy(number.alias("body_id")).agg(
        F.array_sort(F.collect_list(F.struct("line_number", "application", "environment", "line", text.alias("entry")))).alias("e")
    )
    quoted = F.array_join(F.transform("e", lambda x: F.concat(F.lit('"'), F.replace(x["line"], F.lit('"'), F.lit('\\"')), F.lit('"'))), ",")
    entries = F.array_join(F.transform("e", lambda x: x["entry"]), ",")
    first = F.col("e")[0]
    named = F.concat(F.lit('{"application":"'), first["application"], F.lit('","environment":"'), first["environment"], F.lit('"'))
    shape = F.col("body_id") % 6
    body = (
        F.when(shape == 0, F.concat(named, F.lit(',"logs":['), quoted, F.lit("]}")))
        .when(shape == 1, F.concat(F.lit('{"application":" ","environment":"x","logs":['), quoted, F.lit("]}")))
        .when(shape == 2, F.concat(F.lit("["), entries, F.lit("]")))
        .when(shape == 3, F.concat(named, F.lit(',"log":"single '), F.col("body_id").cast("string"), F.lit('"}')))
        .when(shape == 4, F.concat(F.lit('[null,"",'), quoted, F.lit("]")))
        .otherwise(F.concat(F.lit('"text '), F.col("body_id").cast("string"), F.lit('"')))
    )
    return grouped.select("body_id", body.alias("body"))


@query
def normalize_envelopes(spark, sf):
    lines, _ = envelopes.normalize_envelopes(_bodies(spark, sf))
    return lines.select("body_id", "line_number", "application", "environment", "source_name", "source_id", "line")


def _per_path(lines: DataFrame) -> DataFrame:
    """Raw lines taken all the way to observations, counted by where they came from."""
    seen = jobs.lines_to_observations(lines)
    return seen.groupBy("source_path", "source_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("id").alias("ids"), F.max("line_number").alias("last_line")
    )


@query
def envelope_observations(spark, sf):
    """Bodies of log shippers as observations: every entry is one, and none is joined across bodies."""
    return _per_path(envelopes.normalize_envelopes(_bodies(spark, sf), ingest_ts="2024-01-31 00:00:00")[0])


@query
def kafka_observations(spark, sf):
    """Messages of a raw topic of four partitions as observations."""
    lines = views.event_lines(spark, sf)
    topic = lines.select(
        F.col("line").cast("binary").alias("value"), (F.col("line_number") % 4).alias("partition"),
        F.col("line_number").alias("offset"), F.col("ingest_ts").alias("timestamp"),
    )
    return _per_path(kafka.decode_raw(topic, "production"))


@query
def rejected_envelopes(spark, sf):
    return envelopes.normalize_envelopes(_bodies(spark, sf))[1].select("body_id", "reason")


@query
def decode_kafka_raw(spark, sf):
    lines = views.event_lines(spark, sf)
    tagged = F.when(
        F.col("line_number") % 2 == 0,
        F.to_json(F.struct(F.col("line").alias("log"), F.col("application").alias("app"), F.lit("tail").alias("tag"))),
    ).otherwise(F.col("line"))
    topic = lines.select("line_number", tagged.cast("binary").alias("value"))
    decoded = kafka.decode_raw(topic, "production", keep_json=False)
    return decoded.select("line_number", "application", "environment", "source_name", "source_id", "line")


@query
def kafka_round_trip(spark, sf):
    """Observations written as messages and read again."""
    seen = conform(views.event_observations(spark, sf), OBSERVATIONS)
    rows, _ = kafka.decode_observations(kafka.encode_observations(seen).select("value"))
    return rows.select("id", "source_id", "template_id", "event_ts", "level", "line_number", "sample_hash")


@query
def kafka_quarantine(spark, sf):
    """Messages without a template, or cut short, are set aside."""
    seen = views.event_observations(spark, sf).withColumn(
        "template_id", F.when(F.col("line_number") % 7 != 0, F.col("template_id"))
    )
    sent = kafka.encode_observations(conform(seen, OBSERVATIONS))
    _, bad = kafka.decode_observations(sent.select("value"))
    return bad.select(F.get_json_object("value", "$.id").alias("id"), "reason")


@query
def encode_messages(spark, sf):
    seen = conform(views.event_observations(spark, sf), OBSERVATIONS)
    sent = kafka.encode_observations(seen)
    return sent.groupBy("key").agg(
        F.count(F.lit(1)).alias("messages"), F.count(F.get_json_object("value", "$.sample_hash")).alias("with_hash")
    )


def _with_broken(messages: DataFrame) -> DataFrame:
    """Values of a topic, each followed by a copy cut short, a copy without what is required, and one that is no object."""
    value = F.col("value")
    cut = F.substring(value, F.lit(1), F.length(value) - 1)
    return messages.select(F.explode(F.array(value, cut, F.lit("{}"), F.lit("[]"))).alias("value"))


@query
def anomalies_through_topic(spark, sf):
    """Incidents sent to a topic and read from it, between messages that cannot be read."""
    back, _ = kafka.decode_anomalies(_with_broken(kafka.encode_anomalies(_incidents(spark, sf))))
    line = F.col("evidence_references")[0]["line_number"].alias("line_number")
    return back.select(
        "id", "anomaly_type", "template_id", "bucket_start", "detected_at", "current_count", "baseline_count", "z_score", "template_text",
        "sample_evidence", "source_paths", line, "application", "environment", "incident_number", "status",
    )


@query
def analyses_through_topic(spark, sf):
    """Verdicts sent to a topic and read from it, between messages that cannot be read."""
    sent = kafka.encode_analyses(_verdicts(_incidents(spark, sf)))
    back, _ = kafka.decode_analyses(_with_broken(sent))
    return back.select(
        "id", "anomaly_id", "model", "prompt_version", "severity", "confidence", "investigate", "summary", "possible_causes",
        "recommended_actions", F.col("error").alias("ai_error"), "is_retryable", "created_at",
    )


@query
def unreadable_messages(spark, sf):
    """Messages of the two topics that were set aside, by topic and reason."""
    found = _incidents(spark, sf)
    _, anomalies_bad = kafka.decode_anomalies(_with_broken(kafka.encode_anomalies(found)))
    _, analyses_bad = kafka.decode_analyses(_with_broken(kafka.encode_analyses(_verdicts(found))))
    bad = anomalies_bad.withColumn("topic", F.lit("anomalies")).unionByName(analyses_bad.withColumn("topic", F.lit("analyses")))
    return bad.groupBy("topic", "reason").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.length("value") > 2).alias("cut_short"))


@query
def container_lines(spark, sf):
    """Event lines in the three collector formats, parsed again."""
    lines = views.event_lines(spark, sf)
    stamp = F.date_format("ingest_ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    cri = F.concat(stamp, F.lit("+00:00 stdout F "), F.col("line"))
    syslog = F.concat(F.lit("<34>"), F.date_format("ingest_ts", "MMM dd HH:mm:ss"), F.lit(" host-1 "), F.col("application"), F.lit("[77]: "), F.col("line"))
    docker = F.to_json(F.struct(F.concat(F.col("line"), F.lit("\n")).alias("log"), F.lit("stderr").alias("stream"), F.concat(stamp, F.lit("Z")).alias("time")))
    keep = ["line_number", "fmt", "matched", "time_text", "stream", "host", "ident", "pid", "log", "event_ts"]
    parts = []
    for fmt, text in (("cri", cri), ("syslog", syslog), ("docker", docker)):
        shipped = lines.select("line_number", F.lit(fmt).alias("fmt"), text.alias("line"))
        parts.append(containers.parse_container_lines(shipped, fmt, year=F.lit(2024)).select(*keep))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Event lines packed as gzipped payloads of twenty."""
    lines = views.event_lines(spark, sf)
    event = F.struct(
        F.col("line_number").cast("string").alias("id"), F.unix_millis("ingest_ts").alias("timestamp"), F.col("line").alias("message")
    )
    packed = lines.groupBy(F.floor(F.col("line_number") / 20).alias("payload_id")).agg(
        F.array_sort(F.collect_list(event)).alias("logEvents")
    )
    text = packed.select(
        "payload_id",
        F.to_json(
            F.struct(
                F.concat(F.lit("/aws/group-"), (F.col("payload_id") % 3).cast("string")).alias("logGroup"),
                F.lit("stream-1").alias("logStream"),
                "logEvents",
            )
        ).alias("json"),
    )

    def pack(value: str) -> bytes:
        import gzip

        return gzip.compress(value.encode())

    # Not an Arrow function: a worker holds a hundred payloads at once, not ten thousand.
    packed_bytes = F.udf(pack, T.BinaryType(), useArrow=False).asNondeterministic()
    return text.select("payload_id", F.base64(packed_bytes("json")).alias("data"))


@query
def cloudwatch_observations(spark, sf):
    """Payloads of a cloud log service as observations."""
    return _per_path(cloudwatch.decode_cloudwatch(_payloads(spark, sf), ingest_ts="2024-01-31 00:00:00")[0])


@query
def decode_cloudwatch(spark, sf):
    """Event lines packed as gzipped payloads of twenty, decoded again."""
    decoded, _ = cloudwatch.decode_cloudwatch(_payloads(spark, sf))
    return decoded.select("payload_id", "line_number", "application", "source_name", "source_id", "message", "timestamp_ms", "stream")


def _written_lines(spark: SparkSession, sf: str, compression: str) -> str:
    """Document lines written as rolled text files, one folder per language.

    Each task writes the lines of its documents, sorted, so no file grows with the language; a compressed file is read by one task.
    """
    path = new_path(spark, f"lines-{compression}")
    lines = views.document_lines(spark, sf).select("environment", F.regexp_replace("line", "\r", "").alias("value"))
    lines.sortWithinPartitions("environment", "value").write.partitionBy("environment").option("compression", compression).text(path)
    return path


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Per language: lines, distinct line numbers and last line numbers, added up over its files, and the first line number."""
    lines = files.read_log_files(spark, path, recursive=True)
    by_file = lines.groupBy("source_path").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_distinct("line_number").alias("numbers"),
        F.min("line_number").alias("first"),
        F.max("line_number").alias("last"),
    )
    language = F.regexp_extract("source_path", "environment=([a-z]+)", 1)
    return by_file.groupBy(language.alias("lang")).agg(
        F.sum("lines").alias("lines"), F.sum("numbers").alias("numbers"), F.max("first").alias("first"), F.sum("last").alias("last")
    )


@query
def read_log_files(spark, sf):
    return _numbered(spark, _written_lines(spark, sf, "none"))


@query
def read_compressed_logs(spark, sf):
    return _numbered(spark, _written_lines(spark, sf, "gzip"))


@query
def source_settings(spark, sf):
    """Files of three sources, read at once and cut into events by each source's own rule."""
    path = new_path(spark, "sources")
    written = views.configured_lines(spark, sf).select("source", F.col("record").alias("value"))
    written.write.partitionBy("source").text(path)
    rules = {
        "dated": {"multiline": {"pattern": r"^\d{4}-"}},
        "json": {"format": "json"},
        "trace": {"multiline": {"continuation": "java"}},
    }
    sources = catalog.load_sources(
        spark,
        [
            {"id": name, "application": f"app-{name}", "environment": "production", "path": f"{path}/source={name}/*.txt", **rule}
            for name, rule in rules.items()
        ],
    )
    events = jobs.lines_to_events(files.read_source_lines(spark, sources, "2024-01-31 00:00:00"))
    return events.select("source_id", "application", "record", "event_ts", "level")


# --- streams -----------------------------------------------------------------------------------------------


@contextmanager
def _state_partitions(spark: SparkSession):
    """Start stateful streams with at most one state partition per core; the number is fixed at their first start."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), max(1, spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def event_files(spark: SparkSession, sf: str, scoped: bool = True, late: bool = False) -> tuple[str, T.StructType, int]:
    """The events in files of five days each, written in order of time by all tasks; ``late`` sends the first days again at the end.

    Returns the folder, the schema and the number of files of each span, so that a micro-batch is one span.
    """
    path, spans_path = new_path(spark, "events"), new_path(spark, "spans")
    seen = views.event_observations(spark, sf, scoped, dealt=True)
    spanned = seen.withColumn("_span", F.floor(F.datediff("event_ts", F.lit("2024-01-01")) / 5).cast("int"))
    # One folder per span, so that each span is read once and by itself.
    spanned.write.partitionBy("_span").parquet(spans_path)
    parts = spark.read.schema(spanned.schema).parquet(spans_path)
    sizes = {row["_span"]: row["count"] for row in parts.groupBy("_span").count().collect()}
    wanted = max(spark.sparkContext.defaultParallelism, -(-max(sizes.values()) // 250_000))
    files_each = min(wanted, *sizes.values())
    spans = sorted(sizes)
    for span in [*spans, *spans[:1]] if late else spans:
        # Separate writes, so that the file source sees the spans in order of time. Rows are dealt out one by one: no file is empty.
        part = parts.where(F.col("_span") == span).drop("_span").coalesce(files_each).repartition(files_each)
        part.write.mode("append").parquet(path)
    return path, seen.schema, files_each


def event_stream(spark: SparkSession, files: tuple[str, T.StructType, int]) -> DataFrame:
    path, schema, files_each = files
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


@query
def stream_observations(spark, sf):
    return _streamed_observations(spark, sf)


@query
def stream_duplicates(spark, sf):
    """Every fifth line is delivered once more, in a later file; each observation is written once."""
    return _streamed_observations(spark, sf, repeated=True)


def _streamed_observations(spark: SparkSession, sf: str, repeated: bool = False) -> DataFrame:
    path, out = new_path(spark, "lines"), new_path(spark, "observations")
    lines = views.event_lines(spark, sf)
    lines.write.parquet(path)
    if repeated:
        lines.where(F.col("line_number") % 5 == 0).write.mode("append").parquet(path)
    stream = stream_obs.stream_observations(spark.readStream.schema(lines.schema).parquet(path))
    unique = stream_obs.deduplicate(stream)
    with _state_partitions(spark):
        run = (
            unique.writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", new_path(spark, "checkpoint")).trigger(availableNow=True).start()
        )
        run.awaitTermination()
    return spark.read.parquet(out).select("id", "template_id", "sanitized_message", "level", "event_ts", "client_id_hash")


@query
def stream_buckets(spark, sf):
    return stream_rollup.bucket_totals(spark, _streamed_buckets(spark, sf)).select(*_BUCKET)


@query
def stream_late(spark, sf):
    """The first days are delivered once more after the last one: too late to be counted."""
    return stream_rollup.bucket_totals(spark, _streamed_buckets(spark, sf, late=True)).select(*_BUCKET)


@query
def stream_late_repair(spark, sf):
    """The same with late events folded into their old buckets."""
    return stream_rollup.bucket_totals(spark, _streamed_buckets(spark, sf, late=True), late=True).select(*_BUCKET)


@query
def stream_late_rows(spark, sf):
    """The observations that came too late, as they were kept."""
    late = spark.read.parquet(f"{_streamed_buckets(spark, sf, late=True)}/late")
    return late.select("batch", "id", "template_id", "level", "event_ts")


@query
def stream_metrics(spark, sf):
    """What each micro-batch met."""
    return stream_rollup.batch_metrics(spark, _streamed_buckets(spark, sf, late=True))


@query
def stream_compacted(spark, sf):
    """Totals after the deltas were folded into days, the last batch was delivered again, and old days were dropped."""
    folder = _streamed_buckets(spark, sf, late=True)
    stream_rollup.compact(spark, folder)
    path = new_path(spark, "again")
    spark.read.parquet(f"{folder}/late").drop("batch").write.parquet(path)
    last = stream_rollup.batch_metrics(spark, folder).agg(F.max("batch")).first()[0]
    stream_rollup.bucket_batch(spark.read.parquet(path), last, folder, 60)
    stream_rollup.compact(spark, folder, NOW, 240)
    return stream_rollup.bucket_totals(spark, folder, late=True).select(*_BUCKET)


@query
def stream_clients(spark, sf):
    """Distinct clients per bucket, and whether the estimate of the merged sketches is within five percent, or one, of them."""
    totals = stream_rollup.bucket_totals(spark, _streamed_buckets(spark, sf, scoped=False))
    exact = bk.bucket_client_cardinality(views.event_observations(spark, sf, False), 60)
    both = totals.withColumn("estimate", stream_rollup.client_estimate()).drop("clients").join(
        exact, ["template_id", "application", "environment", "bucket_start"]
    )
    off = F.abs(F.col("estimate") - F.col("clients"))
    return both.select("id", "clients", (off <= F.greatest(F.lit(1.0), 0.05 * F.col("clients"))).alias("close"))


_BUCKET = ("id", "template_id", "bucket_start", "bucket_end", "count", "error_count")


def _streamed_buckets(spark: SparkSession, sf: str, late: bool = False, scoped: bool = True) -> str:
    folder = new_path(spark, "buckets")
    stream = event_stream(spark, event_files(spark, sf, scoped, late))
    stream_rollup.start_rollup(stream, folder, new_path(spark, "checkpoint"), 60, available_now=True).awaitTermination()
    return folder


def _streamed_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_path(spark, "detection")
    files = event_files(spark, sf, scoped=False)
    path, schema, _ = files
    with _state_partitions(spark):
        run = stream_detection.start_detection(
            event_stream(spark, files), lambda: spark.read.schema(schema).parquet(path), folder, new_path(spark, "checkpoint"),
            HOURLY, available_now=True,
        )
        run.awaitTermination()
    return stream_detection.found_anomalies(spark, folder)


@query
def stream_anomalies(spark, sf):
    found = _streamed_anomalies(spark, sf)
    return found.select("id", "anomaly_type", "template_id", "bucket_start", "current_count", "baseline_count", "z_score")


@query
def stream_new_templates(spark, sf):
    found = _streamed_anomalies(spark, sf)
    return found.where(F.col("anomaly_type") == "new_template").select("id", "template_id", "detected_at")


@query
def stream_incident_numbers(spark, sf):
    """How many incidents there are, and the first and last of their numbers: no gap and no repeat across micro-batches."""
    found = _streamed_anomalies(spark, sf)
    number = F.substring("incident_number", 4, 7).cast("bigint")
    return found.agg(
        F.count(F.lit(1)).alias("incidents"), F.count_distinct(number).alias("numbers"), F.min(number).alias("lowest"),
        F.max(number).alias("highest"),
    )


@query
def stream_loss(spark, sf):
    """Anomalies that a stream found, marked where late events were lost from their bucket."""
    lost = stream_rollup.ledger_rows(spark, _streamed_buckets(spark, sf, late=True, scoped=False))
    return stream_rollup.with_loss(_streamed_anomalies(spark, sf), lost).select("id", "anomaly_type", "data_loss_warning")


@query
def telemetry_stream(spark, sf):
    """Telemetry of a streamed run: events that came too late, and what the query was behind at its last report."""
    folder = new_path(spark, "buckets")
    stream = event_stream(spark, event_files(spark, sf, late=True))
    run = stream_rollup.start_rollup(stream, folder, new_path(spark, "checkpoint"), 60, available_now=True)
    run.awaitTermination()
    for report in stream_metrics_of.query_metrics(run):
        stream_metrics_of.store_progress(spark, folder, str(run.id), report)
    seen = views.event_observations(spark, sf)
    found = dt.detect_new_templates(seen)
    rows = kpis.telemetry_kpis(
        seen, found, templates.template_catalog(seen), seen.select("source_id").distinct(),
        metrics=stream_rollup.batch_metrics(spark, folder), progress=stream_metrics_of.progress_table(spark, folder),
    )
    return rows.select(
        "total_lines_read", "dropped_events", "consumer_lag", "active_anomalies_count", "templates_count", "sources_count", "data_loss_warning"
    )


@query
def stream_triage(spark, sf):
    path, folder = new_path(spark, "anomalies"), new_path(spark, "triage")
    found = _incidents(spark, sf)
    found.write.parquet(path)
    stream = spark.readStream.schema(found.schema).parquet(path)
    triage_stream.start_triage(stream, folder, new_path(spark, "checkpoint"), available_now=True).awaitTermination()
    return spark.read.parquet(f"{folder}/analyses").select("anomaly_id", "severity", "confidence", "summary")


@query
def pipeline_anomalies(spark, sf):
    """Raw multiline logs to anomalies in one chain."""
    lines = views.multiline_lines(spark, sf)
    tables = jobs.run_pipeline(lines, limits=HOURLY)
    return tables.anomalies.groupBy("application", "environment", "anomaly_type").agg(
        F.count(F.lit(1)).alias("anomalies"), F.count_distinct("template_id").alias("templates")
    )

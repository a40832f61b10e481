"""Job ``triage``: anomalies, memory and feedback in, verdicts and their context out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternlog.functions.ids import row_id
from lanternlog.functions.parsing import strict_variant
from lanternlog.operators import incidents, memory
from lanternlog.operators.ranking import top_rows
from lanternlog.schemas import ANALYSES, CONFIDENCES, SEVERITIES, conform
from lanternlog.session import materialize


@dataclass(frozen=True)
class TriageRule:
    keywords: tuple[str, ...]
    severity: str
    confidence: str
    causes: tuple[str, ...]
    actions: tuple[str, ...]
    summary: str


# The rules in order of priority, then the verdict when none applies.
RULES = (
    TriageRule(
        ("fatal", "outage", "corrupt", "panic", "segmentation fault", "deadlock"),
        "Sev-0",
        "high",
        (
            "Critical process crash or unhandled kernel/system panic.",
            "Severe data corruption or resource deadlock.",
        ),
        (
            "Restart the failing service instance immediately.",
            "Inspect memory/disk diagnostics and database connectivity.",
        ),
        "Critical fatal failure detected in {application} requiring immediate SRE intervention.",
    ),
    TriageRule(
        (
            "database", "connection refused", "500 internal", "timeout", "circuit breaker", "auth failure",
            "failed to connect",
        ),
        "Sev-1",
        "high",
        (
            "Downstream database or dependency service outage/unavailability.",
            "Network partition or connection pool exhaustion.",
        ),
        (
            "Check health of backing database and message brokers.",
            "Verify connection pool limits and service credentials.",
        ),
        "Major service degradation detected: frequent connectivity or internal server errors in {application}.",
    ),
    TriageRule(
        ("error", "exception", "failed", "nullpointer", "keyerror", "typeerror", "cannot parse"),
        "Sev-2",
        "medium",
        (
            "Unhandled runtime application exception or invalid incoming payload.",
            "Regression introduced in recent deployment.",
        ),
        (
            "Inspect application stack traces for source line references.",
            "Verify recent deployment changelog.",
        ),
        "Moderate anomaly in {application}: new exception pattern or error spike observed.",
    ),
    TriageRule(
        ("warn", "warning", "retry", "slow query", "deprecated"),
        "Sev-3",
        "medium",
        (
            "Transient network latency triggering retries.",
            "Non-critical resource approaching warning threshold.",
        ),
        (
            "Monitor metrics over next 15 minutes.",
            "Review query execution plans and cache hit ratios.",
        ),
        "Minor anomaly in {application}: elevated warning rate or transient retries.",
    ),
)
DEFAULT_RULE = TriageRule(
    (),
    "Sev-4",
    "high",
    (
        "New template detected during normal operation or background task.",
        "Benign routine operational message.",
    ),
    ("No immediate action needed; dismiss if expected behavior.",),
    "Informational anomaly: newly registered template pattern in {application}.",
)
# Texts that verdicts and contexts carry.
MODEL = "heuristic-sre-engine"
PROMPT_VERSION = "v2.0"
#: How long a triage run may hold its work.
LEASE_SECONDS = 300
LIMITATION = "Judged by fixed rules of this engine; no language model was asked."
EVIDENCE_REASON = "Deterministic anomaly detector evidence"
RECALL_NOTE = " Note: A similar issue occurred in the past and was resolved."
RECALL_STEP = "Previously taken resolution step: "
NO_RESOLUTIONS = "No past incident resolution notes matched for this anomaly pattern."
NO_SIMILAR = "No previous similar incidents found."
NO_FEEDBACK = "No recent user feedback."
NO_RELATED = "No related candidate anomalies in this batch."
NO_CONTEXT = "No active or historical anomalies found."
DEFAULT_SUMMARY = "Anomaly detected in log streams."

CONTEXT_LAYOUT = (
    "application: {application}\nenvironment: {environment}\nanomaly type: {anomaly_type}\n"
    "detected at: {detected_at}\ncount: {current_count} (baseline {baseline_count}, z-score {z_score})\n"
    "template: {template_text}\n\nevidence:\n{evidence}\n\npast resolutions:\n{past_resolutions}\n\n"
    "similar incidents:\n{similar}\n\nrecent feedback:\n{feedback}\n\nsame batch:\n{batch}"
)


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def heuristic_triage(
    anomalies: DataFrame, rules: Sequence[TriageRule] = RULES, default: TriageRule = DEFAULT_RULE
) -> DataFrame:
    """One verdict per anomaly: the first rule with a keyword in the template or its evidence. No shuffle."""
    evidence = F.array_join(F.coalesce("sample_evidence", F.array().cast("array<string>")), " ")
    text = F.lower(F.concat(F.col("template_text"), F.lit(" "), evidence))

    def hits(rule: TriageRule) -> Column:
        found = F.lit(False)
        for keyword in rule.keywords:
            found = found | F.col("_text").contains(keyword)
        return found

    number = F.lit(len(rules))
    for index in reversed(range(len(rules))):
        number = F.when(hits(rules[index]), index).otherwise(number)
    verdicts = F.array(
        *[
            F.struct(
                F.lit(rule.severity).alias("severity"),
                F.lit(rule.confidence).alias("confidence"),
                _strings(rule.causes).alias("possible_causes"),
                _strings(rule.actions).alias("recommended_actions"),
                F.lit(rule.summary).alias("summary"),
            )
            for rule in (*rules, default)
        ]
    )
    judged = anomalies.withColumn("_text", text).withColumn("_rule", number)
    judged = judged.withColumn("_verdict", F.get(verdicts, F.col("_rule")))
    rows = judged.select(
        F.col("id").alias("anomaly_id"),
        row_id(F.lit(MODEL), F.col("id")).alias("id"),
        F.lit(MODEL).alias("model"),
        F.lit(PROMPT_VERSION).alias("prompt_version"),
        "_verdict.severity",
        "_verdict.confidence",
        (F.col("_verdict.severity") != "Sev-4").alias("investigate"),
        F.replace(F.col("_verdict.summary"), F.lit("{application}"), F.col("application")).alias("summary"),
        default_evidence().alias("evidence"),
        "_verdict.possible_causes",
        "_verdict.recommended_actions",
        _strings([LIMITATION]).alias("limitations"),
        F.lit(True).alias("is_retryable"),
        F.lit(5).alias("execution_time_ms"),
        F.col("detected_at").alias("created_at"),
    )
    return conform(rows, ANALYSES)


def default_evidence() -> Column:
    """Evidence of an anomaly: its references, else one entry per source path."""
    references = F.transform(
        "evidence_references",
        lambda r: F.create_map(
            F.lit("template_id"), r["template_id"],
            F.lit("source_id"), r["source_id"],
            F.lit("source_path"), r["source_path"],
            F.lit("line_number"), r["line_number"].cast("string"),
            F.lit("timestamp"), r["timestamp"].cast("string"),
            F.lit("sample_hash"), r["sample_hash"],
        ),
    )
    paths = F.transform(
        "source_paths",
        lambda path: F.create_map(
            F.lit("template_id"), F.col("template_id"),
            F.lit("source_path"), path,
            F.lit("reason"), F.lit(EVIDENCE_REASON),
        ),
    )
    return F.when(F.size(F.coalesce("evidence_references", F.array())) > 0, references).otherwise(paths)


def _matches_by_template(
    found: DataFrame, texts: DataFrame, line: Column
) -> DataFrame:
    """Lines of matched memory texts per template text, in order of rank."""
    lines = found.join(texts, "id").select(F.col("query_id").alias("template_text"), "rank", line.alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "line")))
    return lines.groupBy("template_text").agg(F.transform(ordered, lambda m: m["line"]).alias("lines"))


def template_queries(anomalies: DataFrame) -> DataFrame:
    """Each distinct template text once, embedded: what memory is searched for."""
    distinct = anomalies.select(F.col("template_text").alias("query_id")).distinct()
    return memory.embed_text(distinct.withColumn("text", F.col("query_id")), ["query_id"], "text")


def apply_past_resolutions(verdicts: DataFrame, anomalies: DataFrame, corpus: DataFrame) -> DataFrame:
    """Put the steps of similar resolved incidents in front of the recommended actions."""
    found = memory.search_resolutions(template_queries(anomalies), corpus)
    notes = memory.resolution_notes(F.col("text_content"))
    steps = _matches_by_template(
        found.drop("text_content"), corpus.select("id", "text_content"), F.concat(F.lit(RECALL_STEP), notes)
    )
    subject = anomalies.select(F.col("id").alias("anomaly_id"), "template_text")
    recalled = subject.join(steps, "template_text").select("anomaly_id", F.col("lines").alias("_steps"))
    known = F.col("_steps").isNotNull()
    actions = F.concat(F.array_compact("_steps"), F.col("recommended_actions"))
    joined = verdicts.join(recalled, "anomaly_id", "left")
    return conform(
        joined.withColumn("summary", F.when(known, F.concat("summary", F.lit(RECALL_NOTE))).otherwise(F.col("summary")))
        .withColumn("recommended_actions", F.when(known, actions).otherwise(F.col("recommended_actions"))),
        ANALYSES,
    )


def _filled(lines: Column, fallback: str) -> Column:
    joined = F.array_join(lines, "\n")
    return F.when(F.size(lines) > 0, joined).otherwise(F.lit(fallback))


def feedback_lines(feedback: DataFrame, newest: int = 5) -> DataFrame:
    """One row with the newest feedback as one text."""
    recent = incidents.recent_feedback(feedback, newest)
    line = F.concat(
        F.lit("- Anomaly "), F.col("anomaly_id"), F.lit(": Action="), F.col("action"), F.lit(", Comment="),
        F.coalesce("comment", F.lit("None")),
    )
    numbered = F.struct(-F.unix_micros("created_at"), F.col("id"), line.alias("line"))
    return recent.agg(F.array_sort(F.collect_list(numbered)).alias("_all")).select(
        F.lit(1).alias("_one"), _filled(F.transform("_all", lambda f: f["line"]), NO_FEEDBACK).alias("feedback")
    )


def triage_context(
    anomalies: DataFrame,
    corpus: DataFrame,
    feedback: DataFrame,
    batch_keys: tuple[str, ...] = ("application", "environment", "batch_start"),
    batch_seconds: int = 60,
    layout: str = CONTEXT_LAYOUT,
) -> DataFrame:
    """Everything known about each anomaly as texts, and all of it in one ``context`` text."""
    texts = corpus.select("id", "text_content")
    queries = template_queries(anomalies)
    # One search serves both lists: the best six are looked through for resolutions, the best three are similar incidents.
    matches = materialize(memory.search_similar(queries, corpus, 6, 0.25))
    resolved = memory.resolutions_among(matches, corpus).drop("text_content")
    resolutions = _matches_by_template(
        resolved, texts,
        F.concat(F.lit("- [Past Resolution Match, Score: "), F.col("score").cast("string"), F.lit("] "), F.col("text_content")),
    ).withColumnRenamed("lines", "_resolutions")
    similar = _matches_by_template(
        matches.where((F.col("rank") <= 3) & (F.col("score") >= 0.3)), texts,
        F.concat(F.lit("- [Score: "), F.col("score").cast("string"), F.lit("] "), F.col("text_content")),
    ).withColumnRenamed("lines", "_similar")

    batched = anomalies
    if "batch_start" in batch_keys and "batch_start" not in anomalies.columns:
        batched = anomalies.withColumn("batch_start", F.window("detected_at", f"{batch_seconds} seconds")["start"])
    related = incidents.related_anomalies(batched, batch_keys)
    related_line = lambda r: F.concat(
        F.lit("- "), r["anomaly_type"], F.lit(": "), r["template_text"], F.lit(" (count="),
        r["current_count"].cast("string"), F.lit(", source="), F.array_join(r["source_paths"], ","), F.lit(")"),
    )
    evidence = F.transform("sample_evidence", lambda e: F.concat(F.lit("Line: "), e))
    own = F.concat(F.lit("Template: "), F.col("template_text"))
    rows = (
        related.join(resolutions, "template_text", "left")
        .join(similar, "template_text", "left")
        .withColumn("_one", F.lit(1))
        .join(F.broadcast(feedback_lines(feedback)), "_one")
        .select(
            "id", "application", "environment", "anomaly_type", "detected_at", "current_count", "baseline_count",
            "z_score", "template_text",
            F.when(F.size("sample_evidence") > 0, F.array_join(evidence, "\n")).otherwise(own).alias("evidence"),
            _filled(F.col("_resolutions"), NO_RESOLUTIONS).alias("past_resolutions"),
            _filled(F.col("_similar"), NO_SIMILAR).alias("similar"),
            "feedback",
            _filled(F.transform("related", related_line), NO_RELATED).alias("batch"),
        )
    )
    return rows.withColumn("context", _fill_layout(layout, rows.columns))


def _fill_layout(layout: str, columns: Sequence[str]) -> Column:
    """``layout`` with every ``{column}`` replaced by the column's value."""
    parts: list[Column] = []
    for piece in layout.split("{"):
        name, closed, rest = piece.partition("}")
        if closed and name in columns:
            value = F.coalesce(F.col(name).cast("string"), F.lit("N/A"))
            if name == "detected_at":
                value = F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
            parts += [value, F.lit(rest)]
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def _texts_or_missing(verdict: Column, path: str) -> tuple[Column, Column]:
    """List of texts at ``path`` (empty if missing), and whether the value there is unusable."""
    kind = F.schema_of_variant(F.try_variant_get(verdict, path, "variant"))
    values = F.try_variant_get(verdict, path, "array<string>")
    bad = kind.isNotNull() & ~kind.isin("ARRAY<STRING>", "ARRAY<VOID>")
    empty = F.size(values) == 0
    return F.coalesce(values, F.array().cast("array<string>")), bad & ~F.coalesce(empty, F.lit(False))


def validate_verdicts(answers: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Model answers (``anomaly_id``, ``model``, ``answer``) to verdicts.

    Unknown severities and confidences become ``Sev-3`` and ``medium``, evidence keeps only objects, missing
    lists are empty. An answer that cannot be read is replaced by the heuristic verdict with an error, and
    may be tried again.
    """
    parsed = answers.withColumn("_v", strict_variant(F.col("answer")))
    verdict = F.col("_v")
    get = lambda path, kind: F.try_variant_get(verdict, path, kind)
    kind_at = lambda path: F.schema_of_variant(get(path, "variant"))

    severity, confidence = get("$.severity", "string"), get("$.confidence", "string")
    severity = F.when(severity.isin(*SEVERITIES), severity).otherwise(F.lit("Sev-3"))
    confidence = F.when(confidence.isin(*CONFIDENCES), confidence).otherwise(F.lit("medium"))
    asked = kind_at("$.investigate")
    flag = (
        F.when(asked.isNull(), severity != "Sev-4")
        .when(asked == "BOOLEAN", get("$.investigate", "boolean"))
        .when(asked == "VOID", F.lit(False))
        .when(asked == "STRING", get("$.investigate", "string") != "")
        .otherwise(F.coalesce(get("$.investigate", "double") != 0, F.lit(True)))
    )
    objects = F.filter(
        get("$.evidence", "array<variant>"), lambda e: F.schema_of_variant(e).startswith("OBJECT")
    )
    evidence = F.transform(objects, lambda e: F.try_variant_get(e, "$", "map<string,string>"))
    causes, bad_causes = _texts_or_missing(verdict, "$.possible_causes")
    actions, bad_actions = _texts_or_missing(verdict, "$.recommended_actions")
    single = F.when(kind_at("$.limitations") == "STRING", F.array(get("$.limitations", "string")))
    listed = F.coalesce(single, get("$.limitations", "array<string>"), F.array().cast("array<string>"))
    summary_kind = kind_at("$.summary")
    unusable = (
        F.coalesce(~kind_at("$").startswith("OBJECT"), F.lit(True))
        | F.coalesce(bad_causes, F.lit(False))
        | F.coalesce(bad_actions, F.lit(False))
        | F.coalesce(summary_kind != "STRING", F.lit(False))
    )
    subject = anomalies.select(F.col("id").alias("anomaly_id"), "detected_at", default_evidence().alias("_own"))
    judged = parsed.join(subject, "anomaly_id").withColumn("_bad", unusable)
    good = judged.where(~F.col("_bad")).select(
        "anomaly_id",
        row_id(F.col("model"), F.col("anomaly_id")).alias("id"),
        "model",
        F.lit(PROMPT_VERSION).alias("prompt_version"),
        severity.alias("severity"),
        confidence.alias("confidence"),
        flag.alias("investigate"),
        F.coalesce(get("$.summary", "string"), F.lit(DEFAULT_SUMMARY)).alias("summary"),
        F.when(F.size(evidence) > 0, evidence).otherwise(F.col("_own")).alias("evidence"),
        causes.alias("possible_causes"),
        actions.alias("recommended_actions"),
        F.filter(listed, lambda x: x != "").alias("limitations"),
        F.lit(False).alias("is_retryable"),
        F.col("detected_at").alias("created_at"),
    )
    failed = judged.where("_bad").select("anomaly_id", F.col("model").alias("_model"))
    fallback = (
        heuristic_triage(anomalies.join(failed.select(F.col("anomaly_id").alias("id")), "id", "left_semi"))
        .join(failed, "anomaly_id")
        .withColumn("error", F.concat("_model", F.lit(": unreadable answer")))
        .drop("_model")
    )
    return conform(good, ANALYSES).unionByName(conform(fallback, ANALYSES))


def take_leases(anomalies: DataFrame, now: Column, seconds: int = LEASE_SECONDS) -> DataFrame:
    """(anomaly_id, taken_at, lease_until): claims of a triage run on its work, to be written before it begins."""
    return anomalies.select(
        F.col("id").alias("anomaly_id"), now.cast("timestamp").alias("taken_at"),
        (now.cast("timestamp") + F.make_dt_interval(secs=F.lit(seconds))).alias("lease_until"),
    )


def _newest_lease(leases: DataFrame) -> DataFrame:
    return leases.groupBy(F.col("anomaly_id").alias("id")).agg(F.max(F.struct("taken_at", "lease_until")).alias("_lease"))


def unfinished(anomalies: DataFrame, analyses: DataFrame, leases: DataFrame, now: Column) -> DataFrame:
    """Anomalies without a verdict that no running lease holds: work whose run never ended is handed out again."""
    held = _newest_lease(leases).where(F.col("_lease.lease_until") > now.cast("timestamp")).select("id")
    judged = analyses.select(F.col("anomaly_id").alias("id")).distinct()
    waiting = anomalies.where(F.col("status").isin("active", "analyzing"))
    return waiting.join(held, "id", "left_anti").join(judged, "id", "left_anti")


def status_lifecycle(
    anomalies: DataFrame, analyses: DataFrame, feedback: DataFrame, leases: DataFrame | None = None, now: Column | None = None
) -> DataFrame:
    """Current status: dismissed by feedback, else analyzing under a running lease, else by the newest verdict, else unchanged.

    A lease counts until it ends or a verdict follows it; once it has ended, what was being analyzed is as it was before:
    active, or what the last verdict made of it.
    """
    from lanternlog.operators.merges import apply_feedback

    newest = analyses.groupBy(F.col("anomaly_id").alias("id")).agg(
        F.max_by(F.struct("created_at", "error"), F.struct("created_at", "id")).alias("_newest")
    )
    judged = anomalies.join(newest, "id", "left")
    status = (
        F.when(F.col("_newest").isNull(), F.when(F.col("status") == "analyzing", "active").otherwise(F.col("status")))
        .when(F.col("_newest.error").isNotNull(), F.lit("failed"))
        .otherwise(F.lit("analyzed"))
    )
    if leases is not None:
        judged = judged.join(_newest_lease(leases), "id", "left")
        open_after = F.col("_newest").isNull() | (F.col("_lease.taken_at") > F.col("_newest.created_at"))
        running = (F.col("_lease.lease_until") > now.cast("timestamp")) & open_after
        status = F.when(running, F.lit("analyzing")).otherwise(status)
    return apply_feedback(judged.withColumn("status", status).select(*anomalies.columns), feedback)


def ask_context(
    questions: DataFrame, corpus: DataFrame, active: DataFrame, top_k: int = 5, min_score: float = 0.1, newest: int = 5
) -> DataFrame:
    """Per question (``question_id``, ``text``): the newest open anomalies and the most similar records."""
    asked = memory.embed_text(questions.withColumnRenamed("question_id", "query_id"), ["query_id"], "text")
    found = memory.search_similar(asked, corpus, top_k, min_score)
    line = F.concat(
        F.lit("- Historical Record: "), F.col("text_content"), F.lit(" (Similarity: "),
        F.col("score").cast("string"), F.lit(")"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    history = (
        found.join(corpus.select("id", "text_content"), "id")
        .groupBy(F.col("query_id").alias("question_id"))
        .agg(F.transform(ordered, lambda m: m["line"]).alias("_history"))
    )
    first = active.orderBy(F.desc("detected_at"), "id").limit(newest)
    bullet = F.concat(
        F.lit("- Active Anomaly ["), F.col("application"), F.lit("]: "), F.col("template_text"), F.lit(" (Count: "),
        F.col("current_count").cast("string"), F.lit(", Severity: "), F.coalesce("severity", F.lit("None")), F.lit(")"),
    )
    place = F.struct(-F.unix_micros("detected_at"), F.col("id"), bullet.alias("line"))
    current = first.agg(F.array_sort(F.collect_list(place)).alias("_sorted")).select(
        F.lit(1).alias("_one"), F.transform("_sorted", lambda a: a["line"]).alias("_current")
    )
    total = active.agg(F.count(F.lit(1)).alias("active_anomalies")).select(F.lit(1).alias("_one"), "active_anomalies")
    none = F.array().cast("array<string>")
    return (
        questions.withColumn("_one", F.lit(1))
        .join(F.broadcast(current), "_one")
        .join(F.broadcast(total), "_one")
        .join(history, "question_id", "left")
        .select(
            "question_id",
            _filled(F.concat("_current", F.coalesce("_history", none)), NO_CONTEXT).alias("context"),
            "active_anomalies",
            F.size(F.coalesce("_history", none)).alias("similar_records"),
        )
    )


def chat_window(
    turns: DataFrame, last: int = 20, max_chars: int = 4000, roles: tuple[str, ...] = ("user", "assistant")
) -> DataFrame:
    """The last turns of each conversation (``conv_id``, ``turn``, ``role``, ``text``), cut to a length."""
    recent = top_rows(turns, ["conv_id"], [F.desc("turn")], last).drop("rank")
    spoken = recent.where(F.col("role").isin(*roles) & (F.coalesce("text", F.lit("")) != ""))
    return spoken.withColumn("text", F.substring("text", 1, max_chars))

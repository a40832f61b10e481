"""Sources, messages and streams."""

from __future__ import annotations

import base64
import gzip
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lanternlog.operators import buckets as bk
from lanternlog.operators import detection as dt
from lanternlog.operators import triage
from lanternlog.plans import views
from lanternlog.schemas import ANALYSES, ANOMALIES, OBSERVATIONS, conform
from lanternlog.session import new_path
from lanternlog.sources import catalog, cloudwatch, containers, envelopes, files, kafka
from lanternlog.streaming import detection as stream_detection
from lanternlog.streaming import ledger, metrics, observations, rollup

SF = "/root/testdata/sf0.001"


def test_line_numbers_across_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(1, 3001)]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.log").write_bytes(b"one\r\nbad \xff byte\r\nthree")
    (tmp_path / "c.log.gz").write_bytes(gzip.compress("\n".join(lines[:100]).encode()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = files.read_log_files(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    by_file = {}
    for r in rows:
        by_file.setdefault(r.source_path.rsplit("/", 1)[1], {})[r.line_number] = r.line
    assert by_file["a.log"] == dict(enumerate(lines, 1))
    assert by_file["c.log.gz"] == dict(enumerate(lines[:100], 1))
    assert by_file["b.log"] == {1: "one", 2: "bad � byte", 3: "three"}


def test_sources(spark, tmp_path):
    path = tmp_path / "sources.yaml"
    path.write_text(
        "sources:\n  - {id: a, application: x, environment: prod, path: /l/*.log, multiline: {pattern: '^d', negate: false}}\n"
        "  - {id: b, application: y, environment: prod, path: /m, enabled: false}\n"
    )
    rows = catalog.read_sources(spark, str(path)).collect()
    assert [(r.id, r.multiline_pattern, r.multiline_negate, r.format) for r in rows] == [("a", "^d", False, "auto")]
    with pytest.raises(ValueError):
        catalog.load_sources(spark, [{"id": "c", "path": "/x", "application": " ", "environment": "p"}])


def test_envelopes(spark):
    bodies = [
        (1, json.dumps({"application": "web", "environment": "prod", "logs": ["a", {"message": "b"}, None, " ", 5]})),
        (2, json.dumps({"application": " ", "environment": "prod", "logs": ["a"]})),
        (3, json.dumps([{"log": "x", "application": "svc", "environment": "dev"}, {"log": "y"}])),
        (4, json.dumps({"log": "z", "app": "solo"})), (5, "not json"), (6, "3"), (7, json.dumps(["plain"])),
        (8, json.dumps({"application": "web", "environment": "prod", "logs": []})),
    ]
    lines, rejected = envelopes.normalize_envelopes(spark.createDataFrame(bodies, "body_id int, body string"), "production")
    plain = lambda line: json.dumps(json.loads(line)) if line.startswith("{") else line
    got = sorted((r.body_id, r.line_number, r.application, r.environment, plain(r.line)) for r in lines.collect())
    assert got == [
        (1, 1, "web", "prod", "a"), (1, 2, "web", "prod", '{"message": "b"}'), (1, 5, "web", "prod", "5"),
        (3, 1, "svc", "dev", '{"log": "x", "application": "svc", "environment": "dev"}'), (3, 2, "svc", "dev", '{"log": "y"}'),
        (4, 1, "solo", "production", bodies[3][1]), (7, 1, "default-app", "production", "plain"),
    ]
    assert {r.body_id: r.reason for r in rejected.collect()} == {
        2: "application_and_environment_required", 5: "invalid_json", 6: "not_object_or_array",
    }


def test_cloudwatch(spark):
    payload = {"logGroup": "/aws/lambda/pay/", "logStream": "s", "logEvents": [{"id": "1", "timestamp": 7, "message": "boom"}, {"id": "2", "message": ""}]}
    packed = base64.b64encode(gzip.compress(json.dumps(payload).encode())).decode()
    df = spark.createDataFrame([(1, packed), (2, ""), (3, "!!"), (4, base64.b64encode(b"plain").decode())], "n int, data string")
    lines, bad = cloudwatch.decode_cloudwatch(df)
    assert [(r.n, r.application, r.source_name, r.message, r.timestamp_ms) for r in lines.collect()] == [(1, "aws-lambda-pay", "cloudwatch:/aws/lambda/pay/", "boom", 7)]
    assert json.loads(lines.first().line) == {"message": "boom", "timestamp_ms": 7, "stream": "s"}
    assert bad.count() == 2


def test_raw_topic(spark):
    values = [b"plain text", b'{"message": "m", "application": "a", "env": "e"}', b'{"log": "l", "tag": "t"}', b"{broken}", b"\xff\xfe", b'{"x": 1}']
    got = kafka.decode_raw(spark.createDataFrame([(v,) for v in values], "value binary"), "prod", keep_json=False).collect()
    assert [r.line for r in got] == ["plain text", "m", "l", "{broken}", "��", '{"x": 1}']
    assert (got[1].source_id, got[2].source_name, got[0].application) == ("ingest-a-e", "t", "kafka-raw")


def test_messages_round_trip(spark):
    seen = conform(views.event_observations(spark, SF), OBSERVATIONS)
    found = dt.detect_new_templates(seen)
    sent = kafka.encode_anomalies(found)
    assert sent.first().key == "::".join(found.select("application", "environment").first())
    back, bad = kafka.decode_anomalies(sent.select("value").union(spark.createDataFrame([("{}",), ("x",)], "value string")))
    assert back.schema == ANOMALIES and back.count() == found.count() and bad.count() == 2
    judged = triage.heuristic_triage(found)
    sent = kafka.encode_analyses(judged)
    assert {r.key for r in sent.collect()} == {r.id for r in found.collect()}
    back, bad = kafka.decode_analyses(sent.select("value").union(spark.createDataFrame([('{"anomaly_id": "a"}',), (None,)], "value string")))
    assert back.schema == ANALYSES and sorted(back.collect(), key=repr) == sorted(judged.collect(), key=repr) and bad.count() == 2


def test_sources_scan_their_text_once_besides_the_index(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.log").write_text("one\ntwo\n")
    rows = [(n, n, "prod", n, f"{tmp_path}/{n}/*.log", None, None, None) for n in ("a", "b")]
    sources = spark.createDataFrame(
        rows, "id string, application string, environment string, source_name string, path string, format string, multiline_pattern string, multiline_negate boolean"
    )
    lines = files.read_source_lines(spark, sources, "2024-01-31 00:00:00")
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1
    assert sorted((r.source_id, r.line_number, r.line) for r in lines.collect()) == [(s, i + 1, t) for s in "ab" for i, t in enumerate(("one", "two"))]


def test_containers(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00.5Z stdout F hello world",), ("junk",)], "line string")
    rows = containers.parse_container_lines(df, "cri").collect()
    assert (rows[0].log, rows[0].stream, rows[0].event_ts is not None) == ("hello world", "stdout", True) and not rows[1].matched


def spans(spark, seen, path, days=16, files=3):
    span = F.floor(F.datediff("event_ts", F.lit("2024-01-01")) / days)
    for part in range(2):
        seen.where(span == part).coalesce(files).repartition(files).write.mode("append").parquet(path)
    return lambda: spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", files).parquet(path)


def test_detection_stream_equals_batch(spark):
    seen = views.event_observations(spark, SF, scoped=False)
    path, folder = new_path(spark, "events"), new_path(spark, "detection")
    read = spans(spark, seen, path)
    limits = dt.Thresholds(min_count=2, z_score=1.0, bucket_minutes=60)
    table = lambda: spark.read.schema(seen.schema).parquet(path)
    run = stream_detection.start_detection(read(), table, folder, new_path(spark, "cp"), limits, available_now=True)
    run.awaitTermination()
    assert len(metrics.query_metrics(run)) >= 2
    key = lambda df: {(r.id, r.current_count, r.z_score) for r in df.collect()}
    want = key(dt.union_anomalies(dt.detect_new_templates(seen, limits=limits), dt.detect_spikes(seen, limits=limits)))
    found = stream_detection.found_anomalies(spark, folder)
    assert key(found) == want and len(want) > 5
    numbers = sorted(r.incident_number for r in found.collect())
    assert numbers == [f"INC{i + 1:07d}" for i in range(len(want))]
    # The state holds one row per template, however many events and batches there were.
    rows = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in map(lambda p: json.loads(p.json), run.recentProgress)]
    assert rows and max(rows) <= 4 * seen.select("template_id").distinct().count()


def test_known_templates_and_expiry_of_the_state(spark):
    def rows(day, texts):
        return [(f"{day}-{i}", "s", "app", "prod", t, t, f"{t} {i}", "INFO", datetime(2024, 1, day, 1, i), "/f", i, f"h{day}{i}", "c") for i, t in enumerate(texts)]

    names = "id, source_id, application, environment, template_id, template_text, sanitized_message, level, event_ts, source_path, line_number, sample_hash, client_id_hash"
    types = {"event_ts": "timestamp", "line_number": "bigint"}
    schema = ", ".join(f"{n} {types.get(n, 'string')}" for n in names.split(", "))
    path, folder = new_path(spark, "events"), new_path(spark, "detection")
    for day, texts in ((1, ["a", "b"]), (2, ["a"]), (20, ["c"]), (21, ["c"]), (22, ["b", "k"])):
        spark.createDataFrame(rows(day, texts), schema).coalesce(1).write.mode("append").parquet(path)
    known = spark.createDataFrame(
        [("k", "app", "prod", datetime(2024, 1, 1))], "id string, application string, environment string, last_seen timestamp"
    )
    full = spark.read.parquet(path).schema
    stream = spark.readStream.schema(full).option("maxFilesPerTrigger", 1).parquet(path)
    table = lambda: spark.read.schema(full).parquet(path)
    run = stream_detection.start_detection(
        stream, table, folder, new_path(spark, "cp"), known=known, keep_hours=24 * 30, available_now=True
    )
    run.awaitTermination()
    assert sorted(r.template_id for r in stream_detection.found_anomalies(spark, folder).collect()) == ["a", "b", "c"]
    again = new_path(spark, "detection")
    stream = spark.readStream.schema(full).option("maxFilesPerTrigger", 1).parquet(path)
    run = stream_detection.start_detection(stream, table, again, new_path(spark, "cp"), keep_hours=24 * 5, available_now=True)
    run.awaitTermination()
    # Forgotten after five days without an event, b is new once more.
    days = sorted((r.template_id, r.detected_at.day) for r in spark.read.parquet(f"{again}/anomalies").collect())
    assert days == [("a", 1), ("b", 1), ("b", 22), ("c", 20), ("k", 22)]


def test_rollup_counts_late_rows_once_and_compacts(spark):
    seen = views.event_observations(spark, SF)
    path, folder = new_path(spark, "events"), new_path(spark, "buckets")
    read = spans(spark, seen, path)
    rollup.start_rollup(read(), folder, new_path(spark, "cp"), 60, available_now=True).awaitTermination()
    rows = lambda df: {(r.id, r["count"], r.error_count) for r in df.collect()}
    want = {(r.template_id, r.bucket_start, r["count"]) for r in bk.bucket_counts(seen, 60).collect()}
    first = rollup.bucket_totals(spark, folder)
    assert {(r.template_id, r.bucket_start, r["count"]) for r in first.collect()} == want
    whole = rows(first)
    # Late rows of a third batch, delivered twice.
    late = seen.where(F.to_date("event_ts") <= "2024-01-03")
    for _ in range(2):
        rollup.bucket_batch(late, 2, folder, 60)
    metric = {r.batch: (r.rows, r.late_rows) for r in rollup.batch_metrics(spark, folder).collect()}
    assert metric[2] == (late.count(),) * 2 and metric[0][1] == metric[1][1] == 0
    assert sum(r for r, _ in metric.values()) == seen.count() + late.count()
    assert rows(rollup.bucket_totals(spark, folder)) == whole
    repaired = rows(rollup.bucket_totals(spark, folder, late=True))
    assert sum(n for _, n, _ in repaired) == seen.count() + late.count()
    assert spark.read.parquet(f"{folder}/late").count() == late.count()
    # A reader that began before a compaction sees its version; afterwards the sums are the same and the folders bounded.
    before = rollup.bucket_totals(spark, folder, late=True)
    for _ in range(2):
        rollup.compact(spark, folder)
    assert rows(before) == repaired == rows(rollup.bucket_totals(spark, folder, late=True))
    rollup.bucket_batch(late, 2, folder, 60)
    assert rows(rollup.bucket_totals(spark, folder, late=True)) == repaired
    for batch in (3, 4, 5):
        rollup.bucket_batch(late.limit(5), batch, folder, 60)
        rollup.compact(spark, folder)
    files = ledger.Files(spark, f"{folder}/buckets")
    assert len(files.names("deltas")) <= 3 and len(files.names("manifests")) == ledger.KEPT_VERSIONS
    assert not [n for n in files.names(".") if n.startswith("writing-")]
    # Expired days go, without a trace in the sums.
    kept = rollup.compact(spark, folder, datetime(2024, 1, 31), 240)
    assert min(kept["buckets"]) == "2024-01-21"
    left = {(r.bucket_start, r["count"]) for r in rollup.bucket_totals(spark, folder).collect()}
    assert left == {(start, n) for _, start, n in want if start >= datetime(2024, 1, 21)}
    assert not any(s.startswith("batch=") for s in ledger.Files(spark, f"{folder}/late").names("."))


def test_manifest_of_a_version_is_written_once(spark):
    files = ledger.Files(spark, new_path(spark, "ledger"))
    files.put("manifests/000000000001.json", {"version": 1, "through": 0, "days": {}})
    with pytest.raises(FileExistsError):
        files.put("manifests/000000000001.json", {"version": 1, "through": 9, "days": {}})
    assert ledger.newest(files)["through"] == 0


def test_progress_table(spark):
    folder = new_path(spark, "progress")
    assert metrics.progress_table(spark, folder).count() == 0
    report = {"batchId": 4, "timestamp": "2024-01-01T00:00:00Z", "numInputRows": 9, "sources": [{"metrics": {"maxOffsetsBehindLatest": "7"}}],
              "stateOperators": [{"numRowsDroppedByWatermark": 2}]}
    for _ in range(2):
        metrics.store_progress(spark, folder, "q", metrics.progress_metrics(report))
    row = metrics.progress_table(spark, folder).collect()
    assert [(r.query, r.batch, r.rows, r.consumer_lag, r.dropped_events, r.data_loss_warning) for r in row] == [("q", 4, 9, 7, 2, True)]


def test_file_stream(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    text = "2024-01-01 00:00:01 [ERROR] db down for a@b.org\n   at frame one\n\n2024-01-01 00:00:02 [INFO] same line\n2024-01-01 00:00:02 [INFO] same line\n"
    for name in ("a.log", "b.log"):
        (logs / name).write_text(text)
    out = str(tmp_path / "out")
    lines = files.stream_log_files(spark, str(logs), files_per_trigger=1)
    source = {"source_id": "s", "application": "app", "environment": "prod"}
    observations.start_file_ingest(lines, source, out, str(tmp_path / "cp"), available_now=True).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 6 and len({r.id for r in rows}) == 6 and {r.batch for r in rows} == {0, 1}
    assert sorted((r.line_number, r.level) for r in rows if r.source_path.endswith("a.log")) == [(1, "ERROR"), (4, "INFO"), (5, "INFO")]
    assert all("@" not in r.sanitized_message for r in rows)


def _observed(lines):
    from lanternlog.plans import jobs

    return jobs.lines_to_observations(lines).collect()


def test_network_input_becomes_observations(spark):
    """Bodies, messages and payloads are never joined with each other, and every entry is an event of its own."""
    entries = ["ERROR first", "INFO second", "  at x", "plain"]
    bodies = [(i, json.dumps({"application": "a", "environment": "e", "logs": entries})) for i in range(3)]
    lines, _ = envelopes.normalize_envelopes(spark.createDataFrame(bodies, "body_id int, body string"), ingest_ts="2024-01-01 00:00:00")
    rows = _observed(lines)
    assert len(rows) == 12 == len({r.id for r in rows})
    unnamed, _ = envelopes.normalize_envelopes(spark.createDataFrame([(json.dumps([f"b{i} one", "two"]),) for i in range(3)], "body string"))
    rows = _observed(unnamed)
    assert len(rows) == 6 == len({r.id for r in rows})

    events = [{"id": str(i), "timestamp": 1_700_000_000_000 + i, "message": m} for i, m in enumerate(entries)]
    packed = [base64.b64encode(gzip.compress(json.dumps({"logGroup": "/g", "logStream": f"s{n}", "logEvents": events}).encode())).decode() for n in range(2)]
    lines, bad = cloudwatch.decode_cloudwatch(spark.createDataFrame([(p,) for p in packed], "data string"))
    rows = _observed(lines)
    assert len(rows) == 8 == len({r.id for r in rows}) and bad.count() == 0

    values = [(f"line {i}".encode(), 0, i) for i in range(5)] + [(b"  at frame", 0, 5)]
    topic = spark.createDataFrame(values, "value binary, partition int, offset long").withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))
    rows = _observed(kafka.decode_raw(topic, "prod"))
    assert len(rows) == 6 == len({r.id for r in rows})
    rows = _observed(kafka.decode_raw(topic.drop("partition", "offset"), "prod"))
    assert len(rows) == 6 == len({r.id for r in rows})


def test_sources_with_rules_of_their_own(spark, tmp_path):
    """One scan for sources that lie apart; a file of two sources is read for both; rules belong to sources."""
    for folder, name, text in (
        ("a", "x.log", "2024-01-01 00:00:01 [INFO] one\nnot indented\n2024-01-01 00:00:02 [WARN] two\n"),
        ("b", "x y.log", "job failed\n   at frame\njob done\n"), ("b", "z.txt", "one\ntwo\n"), ("c", "j.log", '{"msg": "m", "level": "error"}\n{broken\n'),
    ):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    base = {"application": "app", "environment": "prod"}
    sources = catalog.load_sources(spark, [
        {"id": "a", "path": f"{tmp_path}/a/*.log", "multiline": {"pattern": r"^\d{4}-"}, **base},
        {"id": "b", "path": f"{tmp_path}/b/x*.log", "multiline": {"continuation": "java"}, **base},
        {"id": "all-b", "path": f"{tmp_path}/b", **base},
        {"id": "c", "path": f"file:{tmp_path}/c/j.log", "format": "json", **base},
    ])
    lines = files.read_source_lines(spark, sources, "2024-01-31 00:00:00")
    assert sorted((r.source_id, r.line_number) for r in lines.collect()) == sorted(
        [("a", n) for n in (1, 2, 3)] + [("b", n) for n in (1, 2, 3)] + [("all-b", n) for n in (1, 1, 2, 2, 3)] + [("c", 1), ("c", 2)]
    )
    from lanternlog.plans import jobs

    got = sorted((r.source_id, r.record, r.level) for r in jobs.lines_to_events(lines).collect())
    assert got == sorted([
        ("a", "2024-01-01 00:00:01 [INFO] one\nnot indented", "INFO"), ("a", "2024-01-01 00:00:02 [WARN] two", "WARN"),
        ("b", "job failed\n   at frame", "UNKNOWN"), ("b", "job done", "UNKNOWN"),
        ("all-b", "job failed\n   at frame", "UNKNOWN"), ("all-b", "job done", "UNKNOWN"), ("all-b", "one", "UNKNOWN"), ("all-b", "two", "UNKNOWN"),
        ("c", '{"msg": "m", "level": "error"}', "ERROR"), ("c", "{broken", "UNKNOWN"),
    ])
    assert files._scans(["f:/l/a.log", "f:/l/b.log", "f:/m/*.log", "f:/l/a.log"]) == [["f:/l/a.log", "f:/l/b.log", "f:/m/*.log"]]
    assert len(files._scans(["f:/l/*.log", "f:/l/a*.log", "f:/l"])) == 3
    assert files.read_source_lines(spark, sources.where("false"), "2024-01-31 00:00:00").count() == 0


def test_stream_triage_recalls_what_was_learned(spark):
    from lanternlog.operators.memory import RESOLUTION_MARK
    from lanternlog.schemas import FEEDBACK
    from lanternlog.streaming import triage

    found = dt.detect_new_templates(conform(views.event_observations(spark, SF), OBSERVATIONS)).limit(3).persist()
    folder = new_path(spark, "triage")
    triage.triage_batch(found, 0, folder)
    assert triage.recalled(spark, folder, 0).count() == 0
    learned = triage.recalled(spark, folder, 1)
    assert learned.count() == 3 and not learned.first().text_content.startswith(RESOLUTION_MARK)
    notes = found.select(
        F.concat(F.lit("f"), "id").alias("id"), F.col("id").alias("anomaly_id"), F.lit("resolved").alias("action"),
        F.lit("restart it").alias("comment"), F.col("detected_at").alias("created_at"),
    )
    triage.remember_resolutions(found, conform(notes, FEEDBACK), folder, "first")
    triage.triage_batch(found, 1, folder)
    rows = spark.read.parquet(f"{folder}/analyses").where("batch = 1").collect()
    assert len(rows) == 3 and all("restart it" in r.recommended_actions[0] for r in rows)
    triage.triage_batch(found, 1, folder)
    assert triage.recalled(spark, folder, 2).count() == 9

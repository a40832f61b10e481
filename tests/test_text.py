"""Redaction, masks and parsing on literal lines."""

from __future__ import annotations

import hashlib
import json
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lanternlog.functions import masks, parsing, redaction, times
from lanternlog.functions.ids import DEFAULT_SALT
from lanternlog.operators import records, sanitize, templates

UUID = "123e4567-e89b-12d3-a456-426614174000"
LINES = [
    "mail to jane.doe+x@corp.example.org from 10.1.2.3 and 10.1.2.4 done",
    "auth Bearer abc.DEF-123== ok", "auth BEARER zzz", "lower bearer tok~1",
    'api_key="s3cr3t-value", next', "password=password", "auth_token : abc;rest", "Secret='x y'",
    "card 4111-1111-1111-1111 and 4111 1111 1111 1111", f"user {UUID} seen", "addr 2001:0db8:85a3:0000:0000:8a2e:0370:7334 up",
    "commit da39a3ee5e6b4b0d3255bfef95601890afd80709 pushed", "jwt eyJhbGciOi.eyJzdWIi.sig-nature end",
    "nothing here", "éa@b.co x", "a@b.co,c@d.org;a@b.co", "1.2.3.4.5 and 999.1.1.1", "", "Bearer ", "password=<REDACTED_SECRET>",
]


def pseudonym(name: str, value: str) -> str:
    return f"<{name}:{hashlib.sha256((DEFAULT_SALT + value).encode()).hexdigest()[:8]}>"


def redact_in_python(text: str) -> tuple[str, list[str]]:
    """The rules one match at a time."""
    tags = []
    plain = {
        "JWT": "<JWT_TOKEN>", "BEARER_TOKEN": "Bearer <BEARER_TOKEN>", "CREDIT_CARD": "<CARD_NUM>", "UUID": "<UUID>",
        "IPV6": "<IPV6>", "HEX_HASH": "<HEX_HASH>",
    }
    for rule in redaction.RULES:
        if re.search(rule.pattern, text):
            tags.append(rule.tag)
        if rule.tag == "SECRET_KEY":
            text = re.sub(rule.pattern, lambda m: m[1] + "<REDACTED_SECRET>" + m[3], text)
        elif rule.tag in ("EMAIL", "IPV4"):
            name = {"EMAIL": "EMAIL", "IPV4": "IP"}[rule.tag]
            text = re.sub(rule.pattern, lambda m, name=name: pseudonym(name, m[0]), text)
        else:
            text = re.sub(rule.pattern, lambda m, rule=rule: plain[rule.tag], text)
    return text, sorted(tags)


def test_redaction_equals_python(spark):
    rows = [(i, line) for i, line in enumerate(LINES)]
    got = redaction.with_redaction(spark.createDataFrame(rows, "i int, line string"), "line", "clean").collect()
    assert {r.i: (r.clean, r.redaction_types) for r in got} == {i: redact_in_python(line) for i, line in rows}


def test_redact_value_equals_redact(spark):
    df = spark.createDataFrame([(line,) for line in LINES], "line string")
    rows = df.select(redaction.redact(F.col("line"))["text"].alias("a"), redaction.redact_value(F.col("line")).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_redaction_survives_filters(spark):
    """A filter on the result must not blow up the plan."""
    df = redaction.with_redaction(spark.createDataFrame([(line,) for line in LINES], "line string"), "line", "clean")
    assert df.where(F.col("clean").contains("<UUID>")).where(F.size("redaction_types") > 0).count() == 1


def test_attributes(spark):
    row = {
        "Client-ID": "42", "HTTP-Status": "500", "status": None, "Password": "x", "trace_id": f"t {UUID}", "http_status": "404",
        "account_id": " ",
    }
    texts = [(json.dumps(x),) for x in (row, {"customerid": "7"}, {})]
    df = spark.createDataFrame(texts, "t string").select(F.from_json("t", "map<string,string>").alias("a"))
    got = df.select(redaction.safe_attributes(F.col("a")).alias("m"), redaction.client_id_hash(F.col("a")).alias("c")).collect()
    assert got[0].m["trace_id"] == "t <UUID>" and set(got[0].m) == {"http_status", "trace_id"}
    assert got[0].c is None  # the last identifier is blank
    assert got[1].c == hashlib.sha256(b"7").hexdigest() and got[2].m == {}


@pytest.mark.parametrize(
    "line, expected",
    [
        ("[10/Oct/2000:13:55:36 -0700] GET /api/v1/orders/8849 HTTP/1.1 200 in 45.2ms bytes 1024KB",
         "<TIMESTAMP> GET <PATH> HTTP/<NUM> <NUM> in <DURATION> bytes <BYTES>"),
        ("Sep  4 13:17:59 host-01 kernel: eth0: MAC 00:1a:2b:3c:4d:5e to fe80::1ff:fe23:4567:890a",
         "<TIMESTAMP> host-<NUM> kernel: eth0: MAC <MAC> to <IP>"),
        (f"13:17:59.004 [ERROR] to https://pay.example.com/v1/x with {UUID} at /var/log/app.log",
         "<TIMESTAMP> [ERROR] to <URL> with <UUID> at <PATH>"),
        ("Fault at 0x7ffee4b2a890 with da39a3ee5e6b4b0d3255bfef95601890afd80709", "Fault at <HEX> with <HASH>"),
        ("user=<EMAIL:a1b2c3d4> ip=<IP:e5f6a7b8> jwt=<JWT_TOKEN> s=<REDACTED_SECRET>", "user=<EMAIL> ip=<IP> jwt=<JWT> s=<SECRET>"),
        ("1-5 -5 +3.5 a-7 1.2.3 x9 7\nsecond 8", "<NUM>-<NUM> <NUM> <NUM> a-<NUM> <NUM>.<NUM> x9 <NUM>"),
    ],
)
def test_masks(spark, line, expected):
    assert spark.createDataFrame([(line,)], "m string").select(masks.mask(F.col("m"))).first()[0] == expected


def test_template_id(spark):
    df = spark.createDataFrame([("app", "prod", "job 5 done"), ("app", "prod", "job 77 done"), ("app", "test", "job 5 done")],
                               "application string, environment string, sanitized_message string")
    ids = [r.template_id for r in templates.mask_templates(df).collect()]
    assert ids[0] == ids[1] != ids[2]
    assert ids[0] == "tmpl_" + hashlib.sha256(b"app:prod:job <NUM> done").hexdigest()[:12]


def test_parameters(spark):
    rows = [
        ("<TIMESTAMP> user <NUM> from <IP> took <DURATION>", "2024-01-01 10:00:00 user 7 from <IP:ab> took 12 ms", ["2024-01-01 10:00:00", "7", "<IP:ab>", "12 ms"]),
        ("no places", "no places", []), ("<NUM>", "42", ["42"]), ("a <*> c <*>", "a b c d e", ["b", "d e"]), ("x <NUM> y", "other text", []),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "t string, m string")
    assert [r[0] for r in df.select(templates.extract_parameters(F.col("t"), F.col("m"))).collect()] == [r[2] for r in rows]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-03-01T10:11:12.5Z", datetime(2024, 3, 1, 10, 11, 12, 500000)), ("[2024-03-01 10:11:12]", datetime(2024, 3, 1, 10, 11, 12)),
        ("2024-03-01T10:11:12+0530", datetime(2024, 3, 1, 4, 41, 12)), ("2024-03-01T10:11:12-02:00", datetime(2024, 3, 1, 12, 11, 12)),
        ("2024/03/01 10:11:12", datetime(2024, 3, 1, 10, 11, 12)), ("2024-03-01", datetime(2024, 3, 1)), ("20240301", datetime(2024, 3, 1)),
        ("2024-03-01T10:11:12,123456789", datetime(2024, 3, 1, 10, 11, 12, 123456)), ("2024-03-01T10", datetime(2024, 3, 1, 10)),
        ("2024", None), ("10:11:12", None), ("1700000000", None), ("2024-13-01", None), ("Jan  1 10:11:12", None),
    ],
)
def test_timestamps(spark, text, expected):
    value = spark.createDataFrame([(text,)], "t string").select(times.parse_timestamp(F.col("t")).cast("timestamp_ntz")).first()[0]
    assert value == expected


def test_parse_records(spark):
    rows = [
        ('{"timestamp": "2024-01-01T00:00:00Z", "level": "err", "message": "boom", "code": 5}', "ERROR", "boom", True),
        ('{"time": "", "ts": "2024-01-01", "severity": "warning", "msg": "m"}', "WARN", "m", True),
        ('{"log": "from shipper"}', "UNKNOWN", "from shipper", False), ('{"broken": ', "UNKNOWN", '{"broken":', False),
        ('{"a": 1} trailing}', "UNKNOWN", '{"a": 1} trailing}', False), ("2024-01-01 10:00:00.123 [WARN] svc: high", "WARN", "2024-01-01 10:00:00.123 [WARN] svc: high", True),
        ("[2024-01-01 10:00:00] fatal stop", "FATAL", "[2024-01-01 10:00:00] fatal stop", True), ("informational only", "UNKNOWN", "informational only", False),
        ("warning then error", "WARN", "warning then error", False),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "record string")
    got = records.parse_records(df).collect()
    assert [(r.level, r.message, r.event_ts is not None) for r in got] == [r[1:] for r in rows]
    assert got[0].attributes["code"] == "5"
    # The line with text behind its object; the one without a closing brace does not look like JSON.
    assert records.quarantine(df).count() == 1


def _assemble(lines, starts):
    out, current = [], None
    for number, line in lines:
        if current is None or starts(line):
            current = [number, [line]]
            out.append(current)
        else:
            current[1].append(line)
    return {(n, "\n".join(part)) for n, part in out}


def test_multiline_in_chunks(spark):
    lines = []
    for i in range(1, 200):
        lines.append((i, "  at frame" if i % 7 and i % 11 else f"2024-01-01 00:00:{i % 60:02d} start {i}"))
    df = spark.createDataFrame([("s", "f", n, t) for n, t in lines], "source_id string, source_path string, line_number long, line string")
    want = _assemble(lines, lambda t: not t.startswith(" "))
    for chunk in (3, 10, 1000):
        got = records.assemble_multiline(df, chunk_lines=chunk).collect()
        assert {(r.line_number, r.record) for r in got} == want


def test_records_across_chunks_of_several_files(spark):
    """Lines before a file's first start, gaps in the numbers, chunks without a start, and null names of files."""
    files = {
        "a": [(n, f"start {n}" if n in (9, 10, 31) else f" more {n}") for n in range(2, 40) if n % 5],
        "b": [(n, f" more {n}") for n in range(1, 25)],
        "c": [(n, f"start {n}") for n in range(1, 12)],
        None: [(1, " more"), (2, "start"), (3, " more"), (4, " more"), (5, "start")],
    }
    rows = [("s", f, n, t, n * 10) for f, lines in files.items() for n, t in lines]
    schema = "source_id string, source_path string, line_number long, line string, extra long"
    df = spark.createDataFrame(rows, schema).repartition(5)
    want = {(f, n, t) for f, lines in files.items() for n, t in _assemble(lines, lambda t: t.startswith("start"))}
    for chunk in (1, 2, 4, 7, 100):
        got = records.assemble_multiline(df, pattern="^start", chunk_lines=chunk).collect()
        assert {(r.source_path, r.line_number, r.record) for r in got} == want and len(got) == len(want)
        assert all(r.extra == 10 * r.line_number and r.line_count == r.record.count("\n") + 1 for r in got)


def test_assembly_shuffles_text_once(spark, tmp_path):
    rows = [("s", "f", n, "start" if n % 6 == 1 else " more") for n in range(1, 60)]
    spark.createDataFrame(rows, "source_id string, source_path string, line_number long, line string").write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x"))
    for chunk in (4, 1000):
        plan = records.assemble_multiline(df, pattern="^start", chunk_lines=chunk)._jdf.queryExecution().sparkPlan().toString()
        prepared = records.assemble_multiline(df, pattern="^start", chunk_lines=chunk)._jdf.queryExecution().executedPlan().toString()
        assert prepared.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_a_record_of_any_length_is_one_event(spark):
    lines = spark.range(2, 150_001).select(F.col("id").alias("line_number"), F.concat(F.lit("  at frame "), F.col("id").cast("string")).alias("line"))
    head = spark.createDataFrame([(1, "2024-01-01 00:00:09 ERROR broken")], "line_number long, line string")
    df = head.unionByName(lines).select(
        F.lit("s").alias("source_id"), F.lit("f").alias("source_path"), "line_number", "line",
        (F.lit("2024-02-01").cast("timestamp") + F.make_interval(secs=F.col("line_number"))).alias("ingest_ts"),
    )
    (row,) = records.parse_records(records.assemble_multiline(df)).collect()
    assert row.line_count == 150_000 and row.level == "ERROR" and row.line_number == 1
    assert str(row.event_ts) == "2024-01-01 00:00:09" and str(row.ingest_ts) == "2024-02-01 00:00:01"


def test_multiline_patterns(spark):
    lines = [(1, "INFO a"), (2, "more"), (3, "INFO b"), (4, "Caused by: x")]
    df = spark.createDataFrame([("s", "f", n, t) for n, t in lines], "source_id string, source_path string, line_number long, line string")
    by = lambda p, negate: sorted(r.record for r in records.assemble_multiline(df, pattern=p, negate=negate).collect())
    assert by("^INFO", True) == ["INFO a\nmore", "INFO b\nCaused by: x"]
    assert by("^(more|Caused)", False) == ["INFO a\nmore", "INFO b\nCaused by: x"]
    assert re.match(parsing.START_PRESETS["python"], "Traceback (most recent call last):")


def test_sanitized_events_lose_raw_text(spark):
    df = spark.createDataFrame([("a", "p", "x@y.org said hi", {"client_id": "1", "service": "s"}, "src-name")],
                               "application string, environment string, message string, attributes map<string,string>, source_name string")
    clean = sanitize.sanitize_events(df)
    row = clean.first()
    assert "message" not in clean.columns and "attributes" not in clean.columns and "@" not in row.sanitized_message
    assert row.metadata == {"service": "s", "source_name": "src-name"}
    assert sanitize.redaction_audit(clean).collect()[0].lines == 1

"""SQL counterparts of the registered queries, for DuckDB on the same tables.

They are written apart from the Spark code: brute-force windows, joins and regular expressions.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}
SPLIT = "TIMESTAMP '2024-01-20'"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _obs(name: str = "obs", scoped: bool = True, where: str = "true") -> str:
    application = "'app-' || (user_id % 4)" if scoped else "'app'"
    environment = "CASE WHEN user_id % 10 < 7 THEN 'production' ELSE 'staging' END" if scoped else "'production'"
    return f"""{name} AS (
  SELECT CAST(event_id AS VARCHAR) AS id, 'ingest-' || application || '-' || environment AS source_id, application,
    environment, 'tmpl_' || substr(sha256(application || ':' || environment || ':' || pattern), 1, 12) AS template_id,
    pattern AS template_text, event_type || ' ' || props AS sanitized_message,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS level, ts AS event_ts,
    '/logs/' || application || '.log' AS source_path, event_id AS line_number,
    sha256(event_type || ' ' || props) AS sample_hash, sha256(CAST(user_id AS VARCHAR)) AS client
  FROM (SELECT *, {application} AS application, {environment} AS environment,
    event_type || ' request by user <NUM> took <DURATION>' AS pattern FROM events) WHERE {where})"""


def _bucket(minutes: int) -> str:
    return f"time_bucket(INTERVAL {minutes} MINUTE, event_ts)"


_KEY = "template_id, application, environment"
_ERRORS = "count(*) FILTER (WHERE level IN ('ERROR', 'CRITICAL', 'FATAL'))"
_ORDER = "event_ts, source_path, line_number, id"


def _counts(source: str = "obs", minutes: int = 5, name: str = "counts") -> str:
    return f"""{name} AS (
  SELECT {_KEY}, {_bucket(minutes)} AS bucket_start, {_bucket(minutes)} + INTERVAL {minutes} MINUTE AS bucket_end,
    count(*) AS count, {_ERRORS} AS error_count FROM {source} GROUP BY ALL)"""


def _samples(source: str = "obs", name: str = "samples") -> str:
    return f"""{name} AS (
  SELECT sample_hash, template_id, source_id, application, environment, sanitized_message, level, event_ts, line_number,
    source_path, event_ts AS created_at, event_ts + INTERVAL 24 HOUR AS expires_at
  FROM {source} QUALIFY row_number() OVER (PARTITION BY sample_hash ORDER BY {_ORDER}) = 1)"""


def _catalog(source: str = "obs", name: str = "catalog") -> str:
    return f"""{name} AS (
  SELECT template_id AS id, any_value(application) AS application, any_value(environment) AS environment,
    any_value(template_text) AS template_pattern, min(event_ts) AS first_seen, max(event_ts) AS last_seen,
    count(*) AS total_count, arg_min(sanitized_message, row({_ORDER})) AS sample_message
  FROM {source} GROUP BY template_id)"""


def _first_hashes(source: str, minutes: int, name: str = "firsts") -> str:
    return f"""{name} AS (
  SELECT template_id, bucket_start, string_agg(sample_hash, ' | ' ORDER BY position) AS sample_hashes FROM (
    SELECT *, row_number() OVER (PARTITION BY template_id, bucket_start ORDER BY arrived, sample_hash) AS position FROM (
      SELECT template_id, {_bucket(minutes)} AS bucket_start, sample_hash, min(event_ts) AS arrived
      FROM {source} GROUP BY ALL)) WHERE position <= 5 GROUP BY ALL)"""


def _add(name: str, *ctes: str, select: str) -> None:
    ORACLES[name] = (("WITH " + ",\n".join(ctes) + "\n") if ctes else "") + select


_ISO = "strftime(bucket_start, '%Y-%m-%dT%H:%M:%S+00:00')"
_DENSE = _obs(scoped=False)

# --- rollup ------------------------------------------------------------------------------------------------

_TIMELINE = """SELECT bucket_start, bucket_end, application, CAST(sum(count) AS BIGINT) AS total_count,
  CAST(sum(error_count) AS BIGINT) AS total_error_count FROM counts GROUP BY ALL
  ORDER BY bucket_start DESC, application LIMIT 30"""
_add("bucket_timeline", _obs(), _counts(), select=_TIMELINE)
_add("bucket_counts", _obs(), _counts(), select="SELECT * FROM counts")
_add("bucket_samples", _DENSE, _first_hashes("obs", 60), select="SELECT * FROM firsts")
_ROLLUP = f"""SELECT template_id || ':' || {_ISO} AS id, counts.*, sample_hashes
  FROM counts JOIN firsts USING (template_id, bucket_start)"""
_add("bucket_rollup", _DENSE, _counts(minutes=60), _first_hashes("obs", 60), select=_ROLLUP)
_LEVELS = ("trace", "debug", "info", "warn", "warning", "error", "critical", "fatal", "unknown")
_add(
    "bucket_severity", _obs(),
    select=f"SELECT {_KEY}, {_bucket(60)} AS bucket_start, "
    + ", ".join(f"count(*) FILTER (WHERE level = '{x.upper()}') AS {x}" for x in _LEVELS) + " FROM obs GROUP BY ALL",
)
_add(
    "bucket_clients", _obs(),
    select=f"SELECT {_KEY}, {_bucket(60)} AS bucket_start, count(DISTINCT client) AS clients FROM obs GROUP BY ALL",
)
_add(
    "bucket_sources", _obs(),
    select=f"""SELECT {_KEY}, {_bucket(60)} AS bucket_start, source_id, min(event_ts) AS first_event,
      max(event_ts) AS last_event, count(*) AS count FROM obs GROUP BY ALL""",
)
_add(
    "template_totals", _obs(),
    select=f"SELECT template_id, count(*) AS total_count, {_ERRORS} AS total_error_count FROM obs GROUP BY ALL",
)


def _scored(source: str = "counts") -> str:
    return f"""scored AS (
  SELECT *, CASE WHEN baseline_buckets >= 3 AND count >= 5 THEN CASE WHEN baseline_std > 0
      THEN (count - baseline_mean) / baseline_std WHEN count > baseline_mean * 3 + 5 THEN 4.0 ELSE 0.0 END END AS z_score
  FROM (SELECT *, count(*) OVER w AS baseline_buckets, avg(count) OVER w AS baseline_mean,
      stddev_pop(count) OVER w AS baseline_std FROM {source}
    WINDOW w AS (PARTITION BY template_id ORDER BY bucket_start ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)))"""


_add(
    "baseline_zscore", _DENSE, _counts(minutes=60), _scored(),
    select="""SELECT template_id, bucket_start, count, baseline_buckets, round(baseline_mean, 6) AS baseline_mean,
      round(baseline_std, 6) AS baseline_std, round(z_score, 6) AS z_score FROM scored""",
)
_RUNNING = f"""running AS (
  SELECT *, {_bucket(60)} AS bucket_start,
    row_number() OVER (PARTITION BY template_id, {_bucket(60)} ORDER BY {_ORDER}) AS running_count FROM obs)"""
_add(
    "running_bucket_count", _DENSE, _RUNNING,
    select="SELECT id, template_id, bucket_start, running_count FROM running",
)
_add(
    "recent_buckets", _obs(), _counts(),
    select="""SELECT template_id, bucket_start, count, error_count,
      row_number() OVER (PARTITION BY template_id ORDER BY bucket_start DESC) AS rank FROM counts QUALIFY rank <= 12""",
)
_add("samples", _obs(), _samples(), select="SELECT * FROM samples")
_RECENT = """recent AS (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY event_ts DESC, sample_hash) AS rank
  FROM samples QUALIFY rank <= {n})"""
_add(
    "recent_samples", _obs(), _samples(), _RECENT.format(n=5),
    select="SELECT template_id, sample_hash, sanitized_message, event_ts, rank FROM recent",
)

# --- lines and records -------------------------------------------------------------------------------------

_APPLICATION = "'app-' || (user_id % 4)"
_ENVIRONMENT = "CASE WHEN user_id % 10 < 7 THEN 'production' ELSE 'staging' END"
_LINES = f"""lines AS (
  SELECT 'ingest-' || application || '-' || environment AS source_id, application, environment,
    '/logs/' || application || '-' || environment || '.log' AS source_path, event_id AS line_number, ts AS ingest_ts, event_type,
    user_id, value, level, stamp,
    CASE WHEN event_id % 3 = 0 THEN '{{"timestamp": "' || replace(stamp, ' ', 'T') || 'Z", "level": "' || level
      || '", "service": "' || application || '", "client_id": "' || user_id || '", "http_status": '
      || CASE event_type WHEN 'error' THEN '500' ELSE '200' END || ', "message": "' || event_type || ' done value=' || value || '"}}'
    ELSE stamp || ' [' || level || '] ' || application || ': ' || event_type || ' for user_id=' || user_id || ' from 10.0.'
      || (user_id % 8) || '.' || user_id || ' mail u' || user_id || '@example.com took ' || value || 'ms' END AS line
  FROM (SELECT *, {_APPLICATION} AS application, {_ENVIRONMENT} AS environment, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS stamp,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS level FROM events))"""
_MULTI = """multi AS (
  SELECT source_path, source_id, application, environment, ingest_ts, line_number * 3 AS line_number, line FROM lines
  UNION ALL SELECT source_path, source_id, application, environment, ingest_ts, line_number * 3 + 1,
    '   at step(' || source_path || ':' || line_number || ')' FROM lines WHERE line LIKE '%[ERROR]%'
  UNION ALL SELECT source_path, source_id, application, environment, ingest_ts, line_number * 3 + 2,
    'Caused by: code ' || (line_number % 7) FROM lines WHERE line LIKE '%[ERROR]%')"""
_RECORDS = r"""records AS (
  SELECT source_path, source_id, application, environment, min(line_number) AS line_number,
    string_agg(line, chr(10) ORDER BY line_number) AS record, count(*) AS line_count, arg_min(ingest_ts, line_number) AS ingest_ts
  FROM (SELECT *, sum(CASE WHEN is_start THEN 1 ELSE 0 END) OVER (PARTITION BY source_path ORDER BY line_number) AS number
    FROM (SELECT *, (line LIKE '{%}' OR regexp_matches(line, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}')
      OR NOT (line LIKE ' %' OR line LIKE 'Caused by:%')) AS is_start FROM multi))
  GROUP BY source_path, source_id, application, environment, number)"""
_PARSED = r"""parsed AS (
  SELECT * EXCLUDE (record), record,
    CAST(CASE WHEN is_json THEN replace(json_extract_string(record, '$.timestamp'), 'Z', '')
      ELSE regexp_extract(record, '^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+') END AS TIMESTAMP) AS event_ts,
    CASE WHEN is_json THEN json_extract_string(record, '$.level') ELSE regexp_extract(record, '\[([A-Z]+)\]', 1) END AS level,
    CASE WHEN is_json THEN json_extract_string(record, '$.message') ELSE record END AS message,
    CASE WHEN is_json THEN 'client_id=' || json_extract_string(record, '$.client_id') || ';http_status='
      || json_extract_string(record, '$.http_status') || ';level=' || json_extract_string(record, '$.level') || ';message='
      || json_extract_string(record, '$.message') || ';service=' || json_extract_string(record, '$.service') || ';timestamp='
      || json_extract_string(record, '$.timestamp') END AS attributes
  FROM (SELECT *, record LIKE '{%}' AS is_json FROM records))"""
_CHAIN = (_LINES, _MULTI, _RECORDS, _PARSED)
_add(
    "assemble_multiline", _LINES, _MULTI, _RECORDS,
    select="SELECT source_path, line_number, record, line_count FROM records",
)
_add("parse_events", *_CHAIN, select="SELECT source_path, line_number, event_ts, level, message, attributes FROM parsed")
_add(
    "enrich_lines", _LINES,
    select="""SELECT source_path, line_number, CASE WHEN environment = 'production' THEN 'svc-' || application END AS service,
      CASE WHEN environment = 'production' THEN 'auto' END AS format FROM lines""",
)
_DOCS = r"""docs AS (
  SELECT doc_id, 'docs-' || source AS source_id, source AS application, lang AS environment, '/docs/' || doc_id AS source_path,
    unnest(generate_series(1, len(parts))) AS line_number, unnest(parts) AS line,
    TIMESTAMP '2024-01-01' + INTERVAL (doc_id) SECOND AS ingest_ts
  FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents)),
doc_lines AS (SELECT *, trim(line, E' \t\r\n\f' || chr(11)) AS message FROM docs WHERE trim(line, E' \t\r\n\f' || chr(11)) <> '')"""
_DOC_LEVEL = r"""CASE upper(regexp_extract(line, '(?i)\b(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|CRITICAL|FATAL)\b', 1))
  WHEN '' THEN 'UNKNOWN' WHEN 'WARNING' THEN 'WARN'
  ELSE upper(regexp_extract(line, '(?i)\b(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|CRITICAL|FATAL)\b', 1)) END"""
_add(
    "parse_documents", _DOCS,
    select=f"""SELECT source_path, line_number, ingest_ts AS event_ts, {_DOC_LEVEL} AS level, message, false AS has_time
      FROM doc_lines""",
)
_add(
    "parse_quality", *_CHAIN, _DOCS,
    f"""read AS (
  SELECT application, environment, is_json, NOT is_json AND record LIKE '{{%}}' AS malformed, event_ts IS NULL AS timeless, level = '' AS levelless,
    contains(record, chr(10)) AS multiline FROM parsed
  UNION ALL SELECT application, environment, is_json AND NOT cut, is_json AND cut, is_json AND cut, is_json AND cut, false
  FROM (SELECT *, line LIKE '{{%}}' AS is_json, line_number % 5 = 0 AS cut FROM lines)
  UNION ALL SELECT application, environment, false, message LIKE '{{%}}', true, {_DOC_LEVEL} = 'UNKNOWN', false FROM doc_lines)""",
    select="""SELECT application, environment, count(*) AS records, count(*) FILTER (is_json) AS json_records,
      count(*) FILTER (malformed) AS malformed_json, count(*) FILTER (timeless) AS without_time,
      count(*) FILTER (levelless) AS without_level, count(*) FILTER (multiline) AS multiline_records FROM read GROUP BY ALL""",
)
_add(
    "quarantine", _LINES,
    select="""SELECT source_path, line_number, array_to_string(string_split(line, ':')[1:3], ':') || '}' AS record,
      'malformed_json' AS reason FROM lines WHERE line_number % 15 = 0""",
)

# --- redaction ---------------------------------------------------------------------------------------------

# Replacement texts of the rules; the two that hash their matches carry a name instead.
_REPLACE = {
    "JWT": "<JWT_TOKEN>", "BEARER_TOKEN": "Bearer <BEARER_TOKEN>", "SECRET_KEY": r"\1<REDACTED_SECRET>\3",
    "CREDIT_CARD": "<CARD_NUM>", "UUID": "<UUID>", "IPV6": "<IPV6>", "HEX_HASH": "<HEX_HASH>",
}
_HASHED = {"EMAIL": "EMAIL", "IPV4": "IP"}
_SALT = "lantern"
# Fixed values, written out here once more so that a slip in the package's own table shows.
_SECRET_RULES = (
    ("JWT", r"\beyJ[A-Za-z0-9_=-]+\.[A-Za-z0-9_=-]+\.?[A-Za-z0-9_.+/=-]*\b"),
    ("BEARER_TOKEN", r"(?i)\bbearer\s+([a-z0-9._~+/-]+=*)"),
    ("SECRET_KEY", r"""(?i)((?:api_key|api-key|apikey|secret|access_token|access-token|accesstoken|password|auth_token|auth-token|authtoken)\s*[:=]\s*["']?)([^"'\s,;]+)(["']?)"""),
    ("CREDIT_CARD", r"\b[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{2,}\b"),
    ("UUID", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
    ("IPV4", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    ("IPV6", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"),
    ("HEX_HASH", r"\b[0-9a-fA-F]{32,64}\b"),
)


def _redacted(source: str, column: str, name: str = "clean") -> str:
    """Rules one after the other; adds ``sanitized_message`` and ``redaction_types``."""
    steps = [f"{name}_0 AS (SELECT *, {column} AS t FROM {source})"]
    for index, (tag, expression) in enumerate(_SECRET_RULES):
        pattern = _text(expression)
        if tag in _HASHED:
            new = (
                f"array_to_string(list_transform(list_zip(regexp_split_to_array(t, {pattern}), regexp_extract_all(t, {pattern})), "
                f"lambda m: m[1] || CASE WHEN m[2] IS NULL THEN '' ELSE '<{_HASHED[tag]}:' || "
                f"substr(sha256('{_SALT}' || m[2]), 1, 8) || '>' END), '')"
            )
            new = f"CASE WHEN regexp_matches(t, {pattern}) THEN {new} ELSE t END"
        else:
            new = f"regexp_replace(t, {pattern}, {_text(_REPLACE[tag])}, 'g')"
        steps.append(
            f"{name}_{index + 1} AS (SELECT * REPLACE ({new} AS t), regexp_matches(t, {pattern}) AS h_{tag} FROM {name}_{index})"
        )
    tags = ", ".join(f"CASE WHEN h_{tag} THEN '{tag}' END" for tag in sorted(tag for tag, _ in _SECRET_RULES))
    steps.append(
        f"{name} AS (SELECT * EXCLUDE (t), t AS sanitized_message, array_to_string(list_filter([{tags}], "
        f"lambda x: x IS NOT NULL), ' | ') AS redaction_types, sha256(t) AS sample_hash FROM {name}_{len(_SECRET_RULES)})"
    )
    return ",\n".join(steps)


_CLEAN = "SELECT source_path, line_number, sanitized_message, redaction_types, sample_hash FROM clean"
_add("redact_documents", _DOCS, _redacted("doc_lines", "message"), select=_CLEAN)
_add("redact_events", *_CHAIN, _redacted("parsed", "message"), select=_CLEAN)
_add(
    "redact_pages", _redacted("pages", "html"),
    select="SELECT page_id, sanitized_message AS sanitized, redaction_types FROM clean",
)
_add(
    "redaction_audit", _DOCS, *_CHAIN, _redacted("doc_lines", "message", "clean"), _redacted("parsed", "message", "clean_events"),
    select="""SELECT application, environment, tag, count(*) AS lines FROM (
      SELECT application, environment, unnest(string_split(redaction_types, ' | ')) AS tag FROM (
        SELECT application, environment, redaction_types FROM clean WHERE redaction_types <> ''
        UNION ALL SELECT application, environment, redaction_types FROM clean_events WHERE redaction_types <> ''))
      GROUP BY ALL""",
)
_add(
    "sanitize_attributes", *_CHAIN,
    select="""SELECT source_path, line_number, CASE WHEN is_json THEN sha256(json_extract_string(record, '$.client_id')) END
      AS client_id_hash, CASE WHEN is_json THEN 'http_status=' || json_extract_string(record, '$.http_status')
        || ';service=' || json_extract_string(record, '$.service') || ';source_name=shipper'
      ELSE 'service=from-source;source_name=shipper' END AS metadata FROM parsed""",
)

# --- templates ---------------------------------------------------------------------------------------------

_EDGE = "[^A-Za-z0-9]"
_DATE, _CLOCK = r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}", r"[0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?"
_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
# Fixed values, written out here once more: masks in their order, each with its name and whether neighbours may be letters or digits.
_MASKS = (
    ("<EMAIL:[^>]+>", "EMAIL", True), ("<IP:[^>]+>", "IP", True), ("<CARD_NUM>", "CARD", True), ("<JWT_TOKEN>", "JWT", True),
    ("<BEARER_TOKEN>", "TOKEN", True), ("<REDACTED_SECRET>", "SECRET", True), ("<UUID>", "UUID", True), ("<IPV6>", "IP", True),
    ("<HEX_HASH>", "HASH", True),
    (rf"\[?{_DATE}[T ]{_CLOCK}(?:Z|[+-][0-9]{{2}}:?[0-9]{{2}})?\]?", "TIMESTAMP", True),
    (rf"\[?[0-9]{{1,2}}/{_MONTH}/[0-9]{{4}}:[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(?:\s+[+-][0-9]{{4}})?\]?", "TIMESTAMP", True),
    (rf"\[?{_MONTH}\s+[0-9]{{1,2}}\s+{_CLOCK}\]?", "TIMESTAMP", True),
    (rf"\[?\b{_DATE}\b\]?", "TIMESTAMP", True),
    (rf"\[?\b{_CLOCK}\b\]?", "TIMESTAMP", True),
    (r"""https?://[^\s"'<>]+""", "URL", True),
    ("(?:[0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}", "MAC", False),
    (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?::[0-9]{1,5})?", "IP", False),
    ("(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{1,4}|::1", "IP", False),
    ("0x[a-fA-F0-9]+", "HEX", False),
    ("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "UUID", True),
    ("[0-9a-fA-F]{32,64}", "HASH", False),
    (r"[0-9]+(?:\.[0-9]+)?\s*(?:µs|us|ns|ms|s|sec|min|m)", "DURATION", False),
    (r"[0-9]+(?:\.[0-9]+)?\s*(?:B|KB|MB|GB|TB|bytes|kb|mb|gb)", "BYTES", False),
    (r"/(?:[a-zA-Z0-9_.-]+/)*[a-zA-Z0-9_.-]+|[a-zA-Z]:(?:\\[a-zA-Z0-9_.-]+)+", "PATH", False),
    (r"[-+]?[0-9]+\.[0-9]+", "NUM", False),
    ("[-+]?[0-9]+", "NUM", False),
)


def _masked(column: str) -> str:
    """All masks as nested replacements. RE2 has no look-around: neighbours are captured and put back, twice over.

    A sign after a letter or digit is kept apart from its number by a mark that is removed at the end.
    """
    sql = f"trim(string_split({column}, chr(10))[1], E' \\t\\r\\n\\f' || chr(11))"
    signed = False
    for pattern, name, free in _MASKS:
        if name == "NUM" and not signed:
            signed = True
            for _ in range(2):
                sql = f"regexp_replace({sql}, '([A-Za-z0-9])([-+])([0-9])', '\\1\\2' || chr(1) || '\\3', 'g')"
        if free:
            sql = f"regexp_replace({sql}, {_text(pattern)}, '<{name}>', 'g')"
        else:
            for _ in range(2):
                sql = f"regexp_replace({sql}, {_text(f'(^|{_EDGE})(?:{pattern})($|{_EDGE})')}, '\\1<{name}>\\2', 'g')"
    return f"replace({sql}, chr(1), '')"


def _mined(name: str = "mined", source: str = "clean") -> str:
    return f"""{name} AS (SELECT *, 'tmpl_' || substr(sha256(application || ':' || environment || ':' || trim(template_text, E' \\t\\r\\n\\f' || chr(11))), 1, 12)
  AS template_id FROM (SELECT *, {_masked('sanitized_message')} AS template_text FROM {source}))"""


_MINED = "SELECT source_path, line_number, template_text, template_id FROM mined"
_SECRETS = """parsed AS (SELECT * EXCLUDE (line), CASE WHEN line_number % 3 = 0 THEN json_extract_string(line, '$.message') ELSE line END || ' ' || CASE line_number % 10
    WHEN 0 THEN 'token eyJhbGciOiJIUzI1NiJ9.eyJ1aWQi' || user_id || '.c2lnbmF0dXJl'
    WHEN 1 THEN 'Authorization: Bearer tok' || user_id || '.x'
    WHEN 2 THEN 'api_key=k' || user_id
    WHEN 3 THEN 'id 123e4567-e89b-12d3-a456-' || lpad(CAST(user_id AS VARCHAR), 12, '0')
    WHEN 4 THEN 'peer 2001:0db8:0000:0000:0000:ff00:0042:' || four
    WHEN 5 THEN 'digest ' || md5(CAST(user_id AS VARCHAR))
    WHEN 6 THEN 'GET https://example.com/path/' || user_id || '?q=1'
    WHEN 7 THEN 'mac 00:1a:2b:3c:4d:' || right(four, 2)
    WHEN 8 THEN 'open /var/log/app/' || user_id || '.log'
    ELSE 'card 4111 1111 1111 ' || four END AS message
  FROM (SELECT *, lpad(right(CAST(user_id AS VARCHAR), 4), 4, '0') AS four FROM lines))"""
_add("redact_secrets", _LINES, _SECRETS, _redacted("parsed", "message"), select=_CLEAN)
_add("mask_secrets", _LINES, _SECRETS, _redacted("parsed", "message"), _mined(), select=_MINED)
_VERSIONS = (
    _obs(),
    """runs AS (SELECT * REPLACE (CASE WHEN run >= 2 AND environment = 'production' THEN replace(wide, 'request', '<*>') ELSE wide END AS template_text)
  FROM (SELECT *, CASE WHEN run >= 1 AND application IN ('app-1', 'app-3') THEN replace(template_text, '<NUM>', '<*>') ELSE template_text END AS wide
    FROM (SELECT *, least((CAST(event_ts AS DATE) - DATE '2024-01-01') // 10, 2) AS run FROM obs)))""",
    """seen_runs AS (SELECT template_id, application, environment, run, template_text AS template_pattern, min(event_ts) AS valid_from
      FROM runs GROUP BY ALL)""",
    """versions AS (SELECT template_id, application, environment, row_number() OVER (PARTITION BY template_id ORDER BY run) AS version,
      template_pattern, valid_from FROM (SELECT *, lag(template_pattern) OVER (PARTITION BY template_id ORDER BY run) AS earlier FROM seen_runs)
      WHERE earlier IS DISTINCT FROM template_pattern)""",
)
_add("template_versions", *_VERSIONS, select="SELECT * FROM versions")
_add(
    "patterns_at_event_time", *_VERSIONS,
    select="""SELECT template_id, version, pattern, count(*) AS events, min(event_ts) AS first_event, max(event_ts) AS last_event
      FROM (SELECT r.id, r.template_id, r.event_ts, max(v.version) AS version, arg_max(v.template_pattern, v.version) AS pattern
        FROM runs r JOIN versions v ON v.template_id = r.template_id AND v.valid_from <= r.event_ts GROUP BY ALL) GROUP BY ALL""",
)
_add(
    "template_sources", _obs(),
    select="""SELECT template_id, application, environment, source_id, min(event_ts) AS first_seen, max(event_ts) AS last_seen,
      count(*) AS count FROM obs GROUP BY ALL""",
)
_add(
    "mined_across_runs", *_CHAIN,
    select=f"""SELECT application, environment, count(*) AS events, count(*) AS fitting, 0 AS misnamed FROM parsed
      WHERE event_ts >= {SPLIT} GROUP BY ALL""",
)
_add(
    "mined_documents_fit", _DOCS,
    select="""SELECT application, environment, count(*) AS lines, count(*) AS fitting, 0 AS ids_over_texts FROM doc_lines GROUP BY ALL""",
)
_EVENT_MINED = (*_CHAIN, _redacted("parsed", "message"), _mined())
_add("mask_events", *_EVENT_MINED, select=_MINED)
_add("mask_documents", _DOCS, _redacted("doc_lines", "message"), _mined(), select=_MINED)
_OBSERVED = """observed AS (SELECT sha256(source_id || '|' || source_path || '|' || line_number || '|0|' || sample_hash) AS id,
  CASE WHEN is_json THEN sha256(json_extract_string(record, '$.client_id')) END AS client_id_hash,
  * EXCLUDE (attributes, message) FROM mined)"""
_add(
    "observations", *_EVENT_MINED, _OBSERVED,
    select="""SELECT id, source_id, application, environment, template_id, template_text, sanitized_message, level, event_ts,
      ingest_ts, source_path, line_number, sample_hash, client_id_hash FROM observed""",
)
_add(
    "extract_parameters", *_EVENT_MINED,
    select=r"""SELECT source_path, line_number, template_text, CASE WHEN is_json
      THEN regexp_extract(sanitized_message, 'value=(.*)$', 1)
      ELSE array_to_string(regexp_extract_all(first, '^(\S+ \S+) \[', 1), '') || ' | ' || regexp_extract(first, '\] app-(\d+):', 1)
        || ' | ' || regexp_extract(first, 'user_id=(\d+) ', 1) || ' | ' || regexp_extract(first, 'from (\S+) mail', 1)
        || ' | ' || regexp_extract(first, 'mail (\S+) took', 1) || ' | ' || regexp_extract(first, 'took (\S+)$', 1) END AS parameters
      FROM (SELECT *, string_split(sanitized_message, chr(10))[1] AS first FROM mined)""",
)
_add("template_catalog", _obs(), _catalog(), select="SELECT * FROM catalog")
_DOC_OBS = """doc_obs AS (SELECT sha256(source_id || '|' || source_path || '|' || line_number || '|0|' || sample_hash) AS id,
  ingest_ts AS event_ts, * EXCLUDE (message) FROM mined)"""
_add(
    "document_templates", _DOCS, _redacted("doc_lines", "message"), _mined(), _DOC_OBS, _catalog("doc_obs"),
    select="SELECT * FROM catalog",
)
_add("top_templates", _obs(), _catalog(), select="SELECT * FROM catalog ORDER BY total_count DESC, id LIMIT 20")
_add(
    "new_templates", _obs(),
    "tagged AS (SELECT * REPLACE (template_id || '-' || substr(sample_hash, 1, 2) AS template_id) FROM obs)",
    select=f"""SELECT template_id, id, event_ts, sanitized_message FROM tagged WHERE event_ts >= {SPLIT} AND template_id NOT IN
      (SELECT template_id FROM tagged WHERE event_ts < {SPLIT})
      QUALIFY row_number() OVER (PARTITION BY template_id ORDER BY {_ORDER}) = 1""",
)

# --- detection ---------------------------------------------------------------------------------------------


def _anomaly_id(kind: str) -> str:
    return f"sha256({kind} || '|' || template_id || '|' || epoch_us(bucket_start))"


def _new(source: str = "obs", minutes: int = 5, name: str = "fresh") -> str:
    return f"""{name} AS (
  SELECT {_anomaly_id("'new_template'")} AS id, 'new_template' AS anomaly_type, template_id, application, environment, bucket_start,
    event_ts AS detected_at, 1 AS current_count, 0.0 AS baseline_count, CAST(NULL AS DOUBLE) AS z_score, template_text,
    sanitized_message AS sample_evidence, source_path AS source_paths, line_number, source_id
  FROM (SELECT *, {_bucket(minutes)} AS bucket_start FROM {source}
    QUALIFY row_number() OVER (PARTITION BY template_id ORDER BY {_ORDER}) = 1))"""


_SPIKES = f"""history AS (
  SELECT template_id, bucket_start, count(*) OVER w AS n, avg(count) OVER w AS mean, stddev_pop(count) OVER w AS std FROM counts
  WINDOW w AS (PARTITION BY template_id ORDER BY bucket_start ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
fired AS (
  SELECT *, CASE WHEN std > 0 THEN (running_count - mean) / std WHEN running_count > mean * 3 + 5 THEN 4.0 ELSE 0.0 END AS z
  FROM running JOIN history USING (template_id, bucket_start) WHERE n >= 3 AND running_count >= 5 AND z >= 3.0
  QUALIFY row_number() OVER (PARTITION BY template_id, bucket_start ORDER BY running_count) = 1),
texts AS (SELECT template_id, string_agg(sanitized_message, ' | ' ORDER BY rank) AS sample_evidence FROM recent GROUP BY ALL),
bursts AS (
  SELECT {_anomaly_id("kind")} AS id, kind AS anomaly_type, template_id, application, environment, bucket_start,
    event_ts AS detected_at, running_count AS current_count, round(mean, 2) AS baseline_count, round(z, 2) AS z_score,
    template_text, texts.sample_evidence, source_path AS source_paths, line_number, source_id
  FROM (SELECT *, CASE WHEN level = 'ERROR' THEN 'error_burst' ELSE 'frequency_spike' END AS kind FROM fired) JOIN texts USING (template_id))"""
_BURSTS = (_DENSE, _counts(minutes=60), _samples(), _RECENT.format(n=3), _RUNNING, _SPIKES)
_SLIM = """SELECT id, anomaly_type, template_id, bucket_start, detected_at, current_count, baseline_count, z_score, template_text,
  sample_evidence, source_paths, line_number FROM """
_add("detect_new_templates", _obs(), _new(), select=_SLIM + "fresh")
_add("frequency_spikes", *_BURSTS, select=_SLIM + "bursts WHERE anomaly_type = 'frequency_spike'")
_add("error_bursts", *_BURSTS, select=_SLIM + "bursts WHERE anomaly_type = 'error_burst'")
_FOUND = (
    *_BURSTS, _new(minutes=60),
    """found AS (SELECT *, 'INC' || lpad(CAST(row_number() OVER (ORDER BY sha256(id)) AS VARCHAR), 7, '0') AS incident_number,
  row_number() OVER (ORDER BY sha256(id)) AS number, 'active' AS status FROM (SELECT * FROM bursts UNION ALL BY NAME SELECT * FROM fresh))""",
)
_add(
    "anomalies", *_FOUND,
    select="SELECT id, incident_number, anomaly_type, template_id, bucket_start, current_count, status FROM found",
)
_add(
    "warning_bursts", _obs(scoped=False, where="event_type = 'signup'"), _counts(minutes=60), _scored(),
    "steps AS (SELECT *, unnest(generate_series(5, count)) AS step FROM scored WHERE z_score >= 3.0)",
    select="""SELECT template_id, bucket_start, count, round(z_score, 4) AS z_score, min(step) AS trigger_count FROM steps
      WHERE CASE WHEN baseline_std > 0 THEN (step - baseline_mean) / baseline_std >= 3.0 ELSE step > baseline_mean * 3 + 5 END
      GROUP BY ALL""",
)
_add(
    "cap_batches", *_FOUND,
    select="""SELECT id, batch_start, place <= 3 AS in_batch, CASE WHEN place <= 3 THEN 'active' ELSE 'failed' END AS status FROM (
      SELECT id, time_bucket(INTERVAL 1 DAY, detected_at) AS batch_start, row_number() OVER (PARTITION BY application, environment,
        time_bucket(INTERVAL 1 DAY, detected_at) ORDER BY detected_at, id) AS place FROM found)""",
)
_BY_FILE = """by_file AS (SELECT * REPLACE ('all' AS application, template_id || '-' || substr(sample_hash, 1, 1) AS template_id) FROM obs)"""
_GROUPS = """groups AS (SELECT application, environment, window_start, count(DISTINCT source_paths) AS sources,
  count(DISTINCT template_id) AS templates, count(DISTINCT id) AS anomalies, count(DISTINCT anomaly_type) AS types,
  max(z_score) AS max_z_score, sha256(application || '|' || environment || '|' || epoch_us(window_start)) AS group_id
  FROM (SELECT *, time_bucket(INTERVAL 60 MINUTE, bucket_start) AS window_start FROM fresh) GROUP BY ALL
  HAVING count(DISTINCT source_paths) >= 2)"""
_GROUPED = (_obs(), _BY_FILE, _new("by_file"), _GROUPS.replace(
    ", sha256(application || '|' || environment || '|' || epoch_us(window_start)) AS group_id", ""))
_GROUP_ID = "sha256(application || '|' || environment || '|' || epoch_us(window_start)) AS group_id"
_add("correlated_anomalies", *_GROUPED, select=f"SELECT *, {_GROUP_ID} FROM groups")
_add(
    "correlation_members", *_GROUPED,
    select=f"""SELECT fresh.id, {_GROUP_ID.replace('application', 'groups.application').replace('environment', 'groups.environment')}
      FROM fresh JOIN groups ON fresh.application = groups.application AND fresh.environment = groups.environment
        AND time_bucket(INTERVAL 60 MINUTE, fresh.bucket_start) = groups.window_start""",
)
_add(
    "field_combinations", *_CHAIN,
    """pairs AS (SELECT application, environment, json_extract_string(record, '$.http_status') AS http_status,
      json_extract_string(record, '$.service') AS service, count(*) AS rows FROM parsed WHERE is_json GROUP BY ALL)""",
    select="""SELECT * FROM (SELECT *, CAST(sum(rows) OVER w AS BIGINT) AS total, rows / sum(rows) OVER w AS share FROM pairs
      WINDOW w AS (PARTITION BY application, environment)) WHERE share <= 0.3""",
)
_add(
    "template_combinations", _DENSE,
    """sets AS (SELECT application, environment, bucket_start, sum(CAST(('0x' || substr(md5(template_id), 1, 15)) AS HUGEINT)) AS combination,
      count(*) AS templates, CAST(sum(n) AS BIGINT) AS rows, max(high) <> min(low) AS across_sources FROM (
        SELECT application, environment, time_bucket(INTERVAL 60 MINUTE, event_ts) AS bucket_start, template_id, count(*) AS n,
          max(source_id) AS high, min(source_id) AS low FROM obs GROUP BY ALL) GROUP BY ALL)""",
    "support AS (SELECT application, environment, combination, count(*) AS buckets FROM sets GROUP BY ALL)",
    select="""SELECT application, environment, bucket_start, CAST(combination AS VARCHAR) AS combination, templates, rows,
      across_sources, buckets, round(buckets / total, 8) AS share FROM sets JOIN support USING (application, environment, combination)
      JOIN (SELECT application, environment, sum(buckets) AS total FROM support GROUP BY ALL) USING (application, environment)
      WHERE buckets / total <= 0.05 AND templates >= 2""",
)

_PAIR_CLASSES = (
    _obs(),
    """seen AS (SELECT environment, time_bucket(INTERVAL 60 MINUTE, event_ts) AS bucket, template_id || '-' || substr(sample_hash, 1, 1) AS t,
      min(source_id) AS low, max(source_id) AS high FROM obs GROUP BY ALL)""",
    "totals AS (SELECT environment, count(DISTINCT bucket) AS total FROM seen GROUP BY ALL)",
    """counted AS (SELECT environment, t, count(*) AS n, string_agg(epoch_us(bucket) || low || high, ';' ORDER BY bucket) AS places
      FROM seen GROUP BY ALL)""",
    """classes AS (SELECT *, min(t) OVER (PARTITION BY environment, places) AS class FROM counted JOIN totals USING (environment)
      WHERE n >= 3 AND 4 * n <= total)""",
)
_add(
    "template_pair_classes", *_PAIR_CLASSES,
    select="SELECT 'all' AS application, environment, t AS template_id, class AS class_id, n AS buckets, total FROM classes",
)
_add(
    "template_pairs", *_PAIR_CLASSES,
    """members AS (SELECT environment, class, total, n, count(*) AS templates FROM classes GROUP BY ALL)""",
    """pairs AS (SELECT environment, a.t AS left_id, b.t AS right_id, count(*) FILTER (WHERE NOT (a.low = a.high AND b.low = b.high AND a.low = b.low)) AS together
      FROM seen a JOIN seen b USING (environment, bucket)
      WHERE a.t < b.t OR (a.t = b.t AND EXISTS (FROM members m WHERE m.class = a.t AND m.environment = a.environment AND m.templates > 1))
      GROUP BY ALL)""",
    select="""SELECT 'all' AS application, environment, left_id, right_id, x.total, x.n AS left_buckets, y.n AS right_buckets,
      x.templates AS left_templates, y.templates AS right_templates, together, round(together * x.total / (x.n * y.n), 8) AS lift
      FROM pairs JOIN members x ON x.class = left_id AND x.environment = pairs.environment
      JOIN members y ON y.class = right_id AND y.environment = pairs.environment
      WHERE together >= 3 AND together * x.total >= 4 * x.n * y.n""".replace("environment, left_id", "pairs.environment AS environment, left_id"),
)

# --- incidents, verdicts, feedback -------------------------------------------------------------------------

_DIGIT = "(strpos('0123456789abcdef', substr(id, 1, 1)) - 1)"
_VERDICTS = f"""verdicts AS (
  SELECT id || '-' || try AS id, id AS anomaly_id, 'Sev-' || ((digit + try) % 5) AS severity, (digit + try) % 5 <> 4 AS investigate,
    'try ' || try || ' of ' || template_text AS summary, 'look | ' || template_text AS recommended_actions,
    CASE WHEN try = 2 AND digit % 2 = 0 THEN 'timeout' END AS ai_error, try = 2 AND digit % 2 = 0 AS is_retryable,
    detected_at + INTERVAL (try) MINUTE AS created_at
  FROM (SELECT *, unnest(generate_series(1, digit % 3)) AS try FROM (SELECT *, {_DIGIT} AS digit FROM found)))"""
_FEEDBACK = """feedback AS (
  SELECT 'fb-' || doc_id AS id, found.id AS anomaly_id, CASE WHEN quality = 1 THEN 'resolved' WHEN toxic = 1 THEN 'false_positive'
    ELSE 'transient' END AS action, 'restarted ' || template_text || ' worker ' || (doc_id % 5) AS comment,
    detected_at + INTERVAL 1 HOUR AS created_at FROM labels JOIN found ON found.number = labels.doc_id)"""
_STATUSES = """statuses AS (
  SELECT found.* REPLACE (CASE WHEN id IN (SELECT anomaly_id FROM feedback) THEN 'dismissed' WHEN newest.anomaly_id IS NULL THEN 'active'
    WHEN newest.ai_error IS NOT NULL THEN 'failed' ELSE 'analyzed' END AS status)
  FROM found LEFT JOIN (SELECT anomaly_id, ai_error FROM verdicts
    QUALIFY row_number() OVER (PARTITION BY anomaly_id ORDER BY created_at DESC, id DESC) = 1) newest ON newest.anomaly_id = found.id)"""
_LATEST = """latest AS (SELECT * FROM verdicts QUALIFY row_number() OVER (PARTITION BY anomaly_id ORDER BY created_at DESC, id DESC) = 1)"""
_CASES = (*_FOUND, _VERDICTS, _FEEDBACK, _STATUSES)
_INCIDENT = "s.id, s.incident_number, s.application, s.status, s.template_text, s.detected_at, s.current_count"
_OPEN = "s.status IN ('active', 'analyzing', 'analyzed', 'failed')"
_add(
    "status_leased", *_CASES,
    """held AS (SELECT *, ascii(right(id, 1)) % 4 AS kind,
      (SELECT max(created_at) FROM verdicts v WHERE v.anomaly_id = statuses.id) AS judged FROM statuses)""",
    select="""SELECT id, CASE WHEN status = 'dismissed' THEN status WHEN kind = 0 AND (judged IS NULL OR judged < TIMESTAMP '2024-01-30 23:59:00')
      THEN 'analyzing' ELSE status END AS status, judged IS NULL AND kind <> 0 AS waiting FROM held""",
)
_add("status_lifecycle", *_CASES, select="SELECT id, incident_number, status FROM statuses")
_add(
    "active_incidents", *_CASES,
    select=f"""SELECT {_INCIDENT}, v.severity, v.investigate, v.summary, v.recommended_actions, v.ai_error, v.is_retryable
      FROM statuses s LEFT JOIN verdicts v ON v.anomaly_id = s.id WHERE {_OPEN}""",
)
_add(
    "active_incidents_latest", *_CASES, _LATEST,
    select=f"""SELECT {_INCIDENT}, v.severity, v.summary, v.ai_error FROM statuses s LEFT JOIN latest v ON v.anomaly_id = s.id
      WHERE {_OPEN}""",
)
_add(
    "dismissed_incidents", *_CASES,
    select=f"""SELECT {_INCIDENT}, f.comment AS dismissal_comment, f.action AS dismissal_action, f.created_at AS dismissed_at,
      v.severity, v.summary FROM statuses s LEFT JOIN feedback f ON f.anomaly_id = s.id LEFT JOIN verdicts v ON v.anomaly_id = s.id
      WHERE s.status = 'dismissed' ORDER BY s.detected_at DESC, s.id, f.created_at, v.created_at LIMIT 50""",
)
_add(
    "filter_incidents", *_CASES, _LATEST,
    select=f"""SELECT {_INCIDENT}, v.severity FROM statuses s JOIN latest v ON v.anomaly_id = s.id
      WHERE {_OPEN} AND v.severity = 'Sev-2' AND s.environment = 'production' AND s.source_paths = '/logs/app.log'""",
)
_add(
    "template_detail", _obs(), _catalog(), _counts(), _samples(), _RECENT.format(n=5),
    """past AS (SELECT template_id, string_agg(CAST(count AS VARCHAR), ',' ORDER BY bucket_start DESC) AS history_counts FROM (
      SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY template_id ORDER BY bucket_start DESC) <= 12) GROUP BY ALL)""",
    "texts AS (SELECT template_id, string_agg(sample_hash, ',' ORDER BY rank) AS sample_hashes FROM recent GROUP BY ALL)",
    select="""SELECT id AS template_id, template_pattern, total_count, sample_message, history_counts, sample_hashes FROM catalog
      LEFT JOIN past ON past.template_id = catalog.id LEFT JOIN texts ON texts.template_id = catalog.id""",
)
_RELATED = """pairs AS (SELECT a.id, b.id AS other, b.anomaly_type, b.template_text, b.current_count, b.source_paths,
  row_number() OVER (PARTITION BY a.id ORDER BY b.detected_at, b.id) AS place FROM found a JOIN found b
  ON a.application = b.application AND a.environment = b.environment AND a.id <> b.id
  AND time_bucket(INTERVAL 1 DAY, a.detected_at) = time_bucket(INTERVAL 1 DAY, b.detected_at))"""
_add(
    "related_incidents", *_FOUND, _RELATED,
    select="""SELECT id, coalesce(string_agg(other, ' | ' ORDER BY place) FILTER (WHERE place <= 3), '') AS related
      FROM found LEFT JOIN pairs USING (id) GROUP BY id""",
)
_add(
    "recent_feedback", *_CASES,
    select="SELECT id, anomaly_id, action, comment, created_at FROM feedback ORDER BY created_at DESC, id LIMIT 10",
)
_add(
    "telemetry", *_CASES,
    select="""SELECT (SELECT round(count(*) / greatest((epoch_us(max(event_ts)) - epoch_us(min(event_ts))) / 1e6, 1.0), 2) FROM obs)
        AS ingestion_rate_lps, (SELECT count(*) FROM obs) AS total_lines_read, 0 AS dropped_events, 0 AS consumer_lag,
      (SELECT count(*) FROM statuses WHERE status <> 'dismissed') AS active_anomalies_count,
      (SELECT count(DISTINCT template_id) FROM obs) AS templates_count, (SELECT count(DISTINCT source_id) FROM obs) AS sources_count,
      (SELECT count(ai_error) FROM verdicts) AS analysis_error_count, false AS data_loss_warning, 0 AS parsing_warnings_count""",
)

# --- merges and retention ----------------------------------------------------------------------------------

_OLD = _obs("old", where=f"ts < {SPLIT} + INTERVAL 1 DAY")
_NEW = _obs("new", where=f"ts >= {SPLIT}")
_add(
    "merge_templates", _OLD, _NEW, _catalog("old", "a"), _catalog("new", "b"),
    select="""SELECT id, coalesce(a.application, b.application) AS application, coalesce(a.environment, b.environment) AS environment,
      coalesce(a.template_pattern, b.template_pattern) AS template_pattern, least(a.first_seen, b.first_seen) AS first_seen,
      greatest(a.last_seen, b.last_seen) AS last_seen, coalesce(a.total_count, 0) + coalesce(b.total_count, 0) AS total_count,
      coalesce(a.sample_message, b.sample_message) AS sample_message FROM a FULL JOIN b USING (id)""",
)
_add(
    "merge_buckets", _OLD, _NEW, _counts("old", 60, "a"), _counts("new", 60, "b"), _first_hashes("old", 60, "fa"),
    _first_hashes("new", 60, "fb"),
    select=f"""SELECT template_id || ':' || {_ISO} AS id, {_KEY}, bucket_start, bucket_start + INTERVAL 60 MINUTE AS bucket_end,
      coalesce(a.count, 0) + coalesce(b.count, 0) AS count, coalesce(a.error_count, 0) + coalesce(b.error_count, 0) AS error_count,
      coalesce(fb.sample_hashes, fa.sample_hashes) AS sample_hashes FROM a FULL JOIN b USING ({_KEY}, bucket_start)
      LEFT JOIN fa USING (template_id, bucket_start) LEFT JOIN fb USING (template_id, bucket_start)""",
)
_add(
    "insert_samples", _OLD, _NEW, _samples("old", "a"), _samples("new", "b"),
    select="SELECT * FROM a UNION ALL SELECT * FROM b WHERE sample_hash NOT IN (SELECT sample_hash FROM a)",
)
_add(
    "insert_anomalies", *_FOUND,
    select=f"""SELECT id, detected_at, CASE WHEN detected_at >= {SPLIT} THEN 0 WHEN anomaly_type = 'new_template' THEN 1 ELSE 3 END
      AS samples FROM found""",
)
_add(
    "merge_analyses", *_FOUND, _VERDICTS,
    select="""SELECT id, anomaly_id, CASE WHEN ai_error IS NULL THEN severity ELSE 'Sev-0' END AS severity, CAST(NULL AS VARCHAR) AS error,
      CAST(NULL AS VARCHAR) AS raw_response, created_at FROM verdicts""",
)
_add(
    "apply_feedback", *_FOUND, _FEEDBACK,
    select="""SELECT id, incident_number, CASE WHEN id IN (SELECT anomaly_id FROM feedback) THEN 'dismissed' ELSE status END AS status
      FROM found""",
)
_add(
    "upsert_sources", _OLD, _NEW,
    select="""SELECT id, application, environment, '/logs/' || application || '.log' AS path,
      CASE WHEN environment = 'production' AND fresh IS NOT NULL THEN 'json' ELSE 'auto' END AS format, true AS enabled,
      CASE WHEN environment = 'production' AND fresh IS NOT NULL THEN fresh ELSE stale END AS last_seen FROM (
        SELECT source_id AS id, application, environment, max(event_ts) AS stale FROM old GROUP BY ALL) LEFT JOIN (
        SELECT source_id AS id, max(event_ts) AS fresh FROM new GROUP BY ALL) USING (id)""",
)
_RUN = "TIMESTAMP '2024-02-12'"
_MEMORY = """records_ai AS (
  SELECT sha256(anomaly_id || '|' || text_content) AS id, template_id, anomaly_id, text_content, created_at FROM (
    SELECT v.anomaly_id, f.template_id, '[' || f.application || '] ' || f.template_text || ' :: ' || v.summary AS text_content, v.created_at
    FROM verdicts v JOIN found f ON f.id = v.anomaly_id)),
records_notes AS (
  SELECT sha256(anomaly_id || '|' || text_content) AS id, template_id, anomaly_id, text_content, created_at FROM (
    SELECT b.anomaly_id, f.template_id, '[Resolution Knowledge - ' || f.application || '/' || f.environment || '] Incident Template: '
      || f.template_text || ' | Anomaly Type: ' || f.anomaly_type || ' | Resolution Notes & Steps: ' || b.comment AS text_content, b.created_at
    FROM feedback b JOIN found f ON f.id = b.anomaly_id WHERE b.action = 'resolved')),
memory AS (SELECT * FROM records_ai UNION ALL SELECT * FROM records_notes)"""
_OLD_TESTS = {
    "samples": ("samples", f"created_at < {_RUN} - INTERVAL 480 HOUR"),
    "analyses": ("verdicts", f"created_at < {_RUN} - INTERVAL 720 HOUR"),
    "feedback": ("feedback", f"created_at < {_RUN} - INTERVAL 720 HOUR"),
    "embeddings": ("records_ai", f"created_at < {_RUN} - INTERVAL 720 HOUR"),
    "anomalies": ("found", f"detected_at < {_RUN} - INTERVAL 720 HOUR"),
    "buckets": ("counts", f"bucket_end < {_RUN} - INTERVAL 720 HOUR"),
    "templates": ("catalog", f"last_seen < {_RUN} - INTERVAL 720 HOUR"),
}
_RETAINED = (*_CASES, _MEMORY, _catalog())
_add(
    "retention_report", *_RETAINED,
    select=f"SELECT {_RUN} AS run_at, "
    + ", ".join(f"(SELECT count(*) FROM {t} WHERE {test}) AS {n}_deleted" for n, (t, test) in _OLD_TESTS.items())
    + ", 'completed' AS status",
)
_add(
    "retained_rows", *_RETAINED,
    select=" UNION ALL ".join(
        f"SELECT '{n}' AS name, count(*) AS rows FROM {t} WHERE NOT ({test})" for n, (t, test) in _OLD_TESTS.items()
    ) + f" UNION ALL SELECT 'evidence', count(*) FROM found WHERE detected_at >= {_RUN} - INTERVAL 480 HOUR",
)

# --- memory and triage -------------------------------------------------------------------------------------


def _embedded(source: str, key: str, text: str, name: str) -> str:
    """Sparse unit vectors: one row per key and filled dimension."""
    return f"""{name}_counts AS (
  SELECT {key}, CAST(('0x' || substr(md5(token), 1, 8)) AS BIGINT) % 128 AS place, count(*) AS n FROM (
    SELECT {key}, unnest(regexp_split_to_array(lower({text}), '\\s+')) AS token FROM {source}) WHERE token <> '' GROUP BY ALL),
{name} AS (SELECT {key}, place, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS w FROM {name}_counts)"""


def _scores(left: str, left_key: str, right: str, right_key: str, name: str) -> str:
    return f"""{name} AS (
  SELECT a.{left_key} AS query_id, b.{right_key} AS id, sum(a.w * b.w) / (any_value(na.w) * any_value(nb.w)) AS raw FROM {left} a
  JOIN {right} b USING (place)
  JOIN (SELECT {left_key}, sqrt(sum(w * w)) AS w FROM {left} GROUP BY ALL) na ON na.{left_key} = a.{left_key}
  JOIN (SELECT {right_key}, sqrt(sum(w * w)) AS w FROM {right} GROUP BY ALL) nb ON nb.{right_key} = b.{right_key}
  GROUP BY ALL)"""


def _best(scores: str, k: int, minimum: float, name: str) -> str:
    return f"""{name} AS (SELECT query_id, id, round(raw, 4) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 4) DESC, id) AS rank FROM {scores} WHERE raw >= {minimum}
  QUALIFY rank <= {k})"""


_add(
    "embed_documents", _embedded("documents", "doc_id", "text", "e"),
    """best AS (SELECT doc_id, count(*) AS dimensions, max(w) AS largest, arg_min(place, row(-w, place)) AS largest_at FROM e GROUP BY ALL)""",
    select="""SELECT doc_id, coalesce(dimensions, 0) AS dimensions, round(coalesce(largest, 0.0), 5) AS largest,
      coalesce(largest_at, 0) AS largest_at FROM documents LEFT JOIN best USING (doc_id)""",
)
_VECTOR_PAIRS = (
    """s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS raw
      FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)""",
    _best("s", 5, 0.2, "best"),
)
_add("similar_vectors", *_VECTOR_PAIRS, select="SELECT query_id, id, score, rank FROM best")
ORACLES["similar_vectors_pruned"] = ORACLES["similar_vectors"]
_add("similar_vectors_recall", *_VECTOR_PAIRS, select="SELECT count(*) AS matches, true AS recall_reached, true AS fewer_pairs FROM best")
_RECORD_COLUMNS = "SELECT id, template_id, anomaly_id, text_content, created_at FROM "
_add("index_records", *_CASES, _MEMORY, select=_RECORD_COLUMNS + "records_ai")
_add("index_resolutions", *_CASES, _MEMORY, select="SELECT id, anomaly_id, text_content, created_at FROM records_notes")


def _search(records: str = "memory", k: int = 6) -> tuple[str, ...]:
    """Matches of the distinct templates in memory: ``near`` for resolutions, ``alike`` for similar incidents."""
    return (
        *_CASES, _MEMORY, "asked AS (SELECT DISTINCT template_text FROM found)",
        _embedded("asked", "template_text", "template_text", "q"), _embedded(records, "id", "text_content", "c"),
        _scores("q", "template_text", "c", "id", "s"), _best("s", k, 0.25, "near"), _best("s", 3, 0.3, "alike"),
        """solved AS (SELECT near.* EXCLUDE (rank), text_content, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, near.id) AS rank
  FROM near JOIN memory USING (id) WHERE contains(text_content, '[Resolution Knowledge')
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, near.id) <= 3)""",
    )


_add("similar_resolutions", *_search(k=120), select="SELECT query_id AS template_text, id, score, rank FROM solved")


# Keywords of the rules in order, then what a verdict of each rule says; the last one is for texts without a keyword.
_KEYWORDS = """keywords(rule, keyword) AS (VALUES
  (0, 'fatal'), (0, 'outage'), (0, 'corrupt'), (0, 'panic'), (0, 'segmentation fault'), (0, 'deadlock'),
  (1, 'database'), (1, 'connection refused'), (1, '500 internal'), (1, 'timeout'), (1, 'circuit breaker'), (1, 'auth failure'),
  (1, 'failed to connect'),
  (2, 'error'), (2, 'exception'), (2, 'failed'), (2, 'nullpointer'), (2, 'keyerror'), (2, 'typeerror'), (2, 'cannot parse'),
  (3, 'warn'), (3, 'warning'), (3, 'retry'), (3, 'slow query'), (3, 'deprecated'))"""
_RULES = """rules(rule, severity, confidence, possible_causes, recommended_actions, template) AS (VALUES
  (0, 'Sev-0', 'high',
   'Critical process crash or unhandled kernel/system panic. | Severe data corruption or resource deadlock.',
   'Restart the failing service instance immediately. | Inspect memory/disk diagnostics and database connectivity.',
   'Critical fatal failure detected in {application} requiring immediate SRE intervention.'),
  (1, 'Sev-1', 'high',
   'Downstream database or dependency service outage/unavailability. | Network partition or connection pool exhaustion.',
   'Check health of backing database and message brokers. | Verify connection pool limits and service credentials.',
   'Major service degradation detected: frequent connectivity or internal server errors in {application}.'),
  (2, 'Sev-2', 'medium',
   'Unhandled runtime application exception or invalid incoming payload. | Regression introduced in recent deployment.',
   'Inspect application stack traces for source line references. | Verify recent deployment changelog.',
   'Moderate anomaly in {application}: new exception pattern or error spike observed.'),
  (3, 'Sev-3', 'medium',
   'Transient network latency triggering retries. | Non-critical resource approaching warning threshold.',
   'Monitor metrics over next 15 minutes. | Review query execution plans and cache hit ratios.',
   'Minor anomaly in {application}: elevated warning rate or transient retries.'),
  (4, 'Sev-4', 'high',
   'New template detected during normal operation or background task. | Benign routine operational message.',
   'No immediate action needed; dismiss if expected behavior.',
   'Informational anomaly: newly registered template pattern in {application}.'))"""
# A separator of the evidence texts is as good as a blank here: no keyword holds one.
_JUDGED = f"""{_KEYWORDS},
judged AS (SELECT found.*, rules.* EXCLUDE (rule, template), replace(template, '{{application}}', application) AS summary
  FROM found JOIN rules ON rules.rule = coalesce((SELECT min(rule) FROM keywords
    WHERE contains(lower(found.template_text || ' ' || replace(found.sample_evidence, ' | ', ' ')), keyword)), 4))"""
_add(
    "heuristic_triage", *_FOUND, _RULES, _JUDGED,
    select="""SELECT id AS anomaly_id, severity, confidence, severity <> 'Sev-4' AS investigate, summary, possible_causes,
      recommended_actions, concat_ws(' ', template_id, source_id, source_paths, line_number) AS evidence FROM judged""",
)
_add(
    "stream_triage", *_FOUND, _RULES, _JUDGED,
    select="""SELECT id AS anomaly_id, severity, confidence, summary FROM judged QUALIFY row_number() OVER (PARTITION BY application,
      environment, time_bucket(INTERVAL 60 SECOND, detected_at) ORDER BY detected_at, id) <= 10""",
)
_STEPS = f"""steps AS (SELECT query_id AS template_text, string_agg('Previously taken resolution step: ' ||
  trim(string_split(text_content, 'Resolution Notes & Steps:')[2]), ' | ' ORDER BY rank) AS steps FROM solved GROUP BY ALL)"""
_add(
    "recalled_triage", *_search("records_notes"), _RULES, _JUDGED, _STEPS,
    select=f"""SELECT id AS anomaly_id, severity, CASE WHEN steps IS NULL THEN summary ELSE summary || ' Note: A similar issue occurred in the past and was resolved.' END AS summary,
      CASE WHEN steps IS NULL THEN recommended_actions ELSE steps || ' | ' || recommended_actions END AS recommended_actions
      FROM judged LEFT JOIN steps USING (template_text)""",
)
_add(
    "triage_context", *_search(), _RELATED,
    """lines_solved AS (SELECT query_id AS template_text, string_agg('- [Past Resolution Match, Score: ' || score || '] ' || text_content,
      chr(10) ORDER BY rank) AS t FROM solved GROUP BY ALL)""",
    """lines_alike AS (SELECT query_id AS template_text, string_agg('- [Score: ' || score || '] ' || text_content, chr(10) ORDER BY rank) AS t
      FROM alike JOIN memory USING (id) GROUP BY ALL)""",
    """lines_feedback AS (SELECT string_agg('- Anomaly ' || anomaly_id || ': Action=' || action || ', Comment=' || comment, chr(10)
      ORDER BY created_at DESC, id) AS t FROM (SELECT * FROM feedback ORDER BY created_at DESC, id LIMIT 5))""",
    """lines_batch AS (SELECT id, string_agg('- ' || anomaly_type || ': ' || template_text || ' (count=' || current_count || ', source='
      || source_paths || ')', chr(10) ORDER BY place) AS t FROM pairs WHERE place <= 10 GROUP BY ALL)""",
    select=f"""SELECT found.id, 'Line: ' || replace(sample_evidence, ' | ', chr(10) || 'Line: ') AS evidence,
      coalesce(a.t, 'No past incident resolution notes matched for this anomaly pattern.') AS past_resolutions, coalesce(b.t, 'No previous similar incidents found.') AS similar,
      coalesce((SELECT t FROM lines_feedback), 'No recent user feedback.') AS feedback,
      coalesce(c.t, 'No related candidate anomalies in this batch.') AS batch FROM found LEFT JOIN lines_solved a USING (template_text)
      LEFT JOIN lines_alike b USING (template_text) LEFT JOIN lines_batch c ON c.id = found.id""",
)
_add(
    "validate_verdicts", *_FOUND, _RULES, _JUDGED,
    f"shaped AS (SELECT *, {_DIGIT} % 8 AS d FROM judged)",
    select=f"""SELECT id AS anomaly_id, CASE WHEN d IN (2, 3, 5) THEN 'heuristic-sre-engine' ELSE 'model-b' END AS model,
      CASE WHEN d IN (2, 3, 5) THEN severity WHEN d = 4 THEN 'Sev-3' ELSE 'Sev-' || (d % 5) END AS severity,
      CASE WHEN d IN (2, 3, 5) THEN confidence WHEN d = 0 THEN 'high' WHEN d = 7 THEN 'low' ELSE 'medium' END AS confidence,
      CASE WHEN d IN (2, 3, 5) THEN severity <> 'Sev-4' WHEN d IN (0, 6) THEN false ELSE true END AS investigate,
      CASE WHEN d IN (2, 3, 5) THEN summary WHEN d = 4 THEN 'Anomaly detected in log streams.' ELSE template_text END AS summary,
      1 AS evidence, CASE WHEN d IN (2, 3, 5) THEN possible_causes WHEN d = 0 THEN 'x' ELSE '' END AS possible_causes,
      CASE WHEN d IN (2, 3, 5) THEN recommended_actions WHEN d = 0 THEN 'y | z' ELSE '' END AS recommended_actions,
      CASE WHEN d IN (2, 3, 5) THEN 'Judged by fixed rules of this engine; no language model was asked.' WHEN d = 0 THEN 'none' WHEN d = 1 THEN 'l1 | l2' ELSE '' END AS limitations,
      CASE WHEN d IN (2, 3, 5) THEN 'model-b: unreadable answer' END AS error, d IN (2, 3, 5) AS is_retryable FROM shaped""",
)
_add(
    "ask_context", *_CASES, _MEMORY, _LATEST,
    "asked AS (SELECT conv_id || '/' || turn AS question_id, text FROM conversations WHERE role = 'user')",
    _embedded("asked", "question_id", "text", "q"), _embedded("memory", "id", "text_content", "c"),
    _scores("q", "question_id", "c", "id", "s"), _best("s", 5, 0.1, "near"),
    """past AS (SELECT query_id AS question_id, string_agg('- Historical Record: ' || text_content || ' (Similarity: ' || score || ')',
      chr(10) ORDER BY rank) AS t, count(*) AS n FROM near JOIN memory USING (id) GROUP BY ALL)""",
    f"""live AS (SELECT s.*, v.severity FROM statuses s LEFT JOIN latest v ON v.anomaly_id = s.id WHERE {_OPEN})""",
    """bullets AS (SELECT string_agg('- Active Anomaly [' || application || ']: ' || template_text || ' (Count: ' || current_count
      || ', Severity: ' || coalesce(severity, 'None') || ')', chr(10) ORDER BY detected_at DESC, id) AS t FROM (
      SELECT * FROM live ORDER BY detected_at DESC, id LIMIT 5))""",
    select="""SELECT question_id, (SELECT t FROM bullets) || coalesce(chr(10) || past.t, '') AS context,
      (SELECT count(*) FROM live) AS active_anomalies, coalesce(n, 0) AS similar_records FROM asked LEFT JOIN past USING (question_id)""",
)
_CHAT = """SELECT conv_id, turn, role, substr(text, 1, {cut}) AS text FROM (
  SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {last})
  WHERE role IN ('user', 'assistant') AND text <> ''"""
ORACLES["chat_window"] = _CHAT.format(last=4, cut=200)
ORACLES["chat_window_full"] = _CHAT.format(last=20, cut=4000)

# --- sources and sinks -------------------------------------------------------------------------------------

_ENTRY = """'{"log":"' || replace(line, '"', '\\"') || '"}'"""
_BODIES = """numbered AS (SELECT *, line_number // 10 AS body_id, row_number() OVER (PARTITION BY line_number // 10 ORDER BY line_number) AS idx,
  first_value(application) OVER (PARTITION BY line_number // 10 ORDER BY line_number) AS app,
  first_value(environment) OVER (PARTITION BY line_number // 10 ORDER BY line_number) AS env FROM lines)"""
_SHIPPED = f"""shipped AS (
      SELECT body_id, idx AS line_number, app AS application, env AS environment, 'http-ingest' AS source_name, line FROM numbered WHERE body_id % 6 = 0
      UNION ALL SELECT body_id, idx, 'fluent-bit', 'production', 'http-ingest', {_ENTRY} FROM numbered WHERE body_id % 6 = 2
      UNION ALL SELECT body_id, 1, app, env, 'http-ingest', '{{"application":"' || app || '","environment":"' || env || '","log":"single ' || body_id || '"}}'
        FROM numbered WHERE body_id % 6 = 3 AND idx = 1
      UNION ALL SELECT body_id, idx + 2, 'default-app', 'production', 'http-ingest', line FROM numbered WHERE body_id % 6 = 4)"""
_add(
    "normalize_envelopes", _LINES, _BODIES, _SHIPPED,
    select="SELECT *, 'ingest-' || application || '-' || environment AS source_id FROM shipped",
)
_add(
    "envelope_observations", _LINES, _BODIES, _SHIPPED,
    select="""SELECT 'http://api/logs/ingest/' || body_id AS source_path, 'ingest-' || application || '-' || environment AS source_id,
      count(*) AS events, count(DISTINCT line_number) AS ids, max(line_number) AS last_line FROM shipped GROUP BY ALL""",
)
_add(
    "kafka_observations", _LINES,
    select="""SELECT 'kafka://raw_logs/' || (line_number % 4) AS source_path,
      'ingest-' || CASE WHEN line LIKE '{%}' THEN coalesce(json_extract_string(line, '$.application'), json_extract_string(line, '$.app'), 'kafka-raw')
        ELSE 'kafka-raw' END || '-' ||
      CASE WHEN line LIKE '{%}' THEN coalesce(json_extract_string(line, '$.environment'), json_extract_string(line, '$.env'), 'production')
        ELSE 'production' END AS source_id,
      count(*) AS events, count(DISTINCT line_number) AS ids, max(line_number) AS last_line FROM lines GROUP BY ALL""",
)
_add(
    "cloudwatch_observations", _LINES,
    select="""SELECT 'cloudwatch:/aws/group-' || (line_number // 20 % 3) || '/stream-1/' || (line_number // 20) AS source_path,
      'ingest-aws-group-' || (line_number // 20 % 3) || '-production' AS source_id, count(*) AS events,
      count(DISTINCT line_number) AS ids, count(*) AS last_line FROM lines GROUP BY ALL""",
)
_add(
    "rejected_envelopes", _LINES, _BODIES,
    select="""SELECT DISTINCT body_id, CASE body_id % 6 WHEN 1 THEN 'application_and_environment_required' ELSE 'not_object_or_array' END AS reason
      FROM numbered WHERE body_id % 6 IN (1, 5)""",
)
_add(
    "decode_kafka_raw", _LINES,
    select="""SELECT line_number, application, environment, source_name, 'ingest-' || application || '-' || environment AS source_id, line FROM (
      SELECT line_number, CASE WHEN line_number % 2 = 0 THEN application ELSE 'kafka-raw' END AS application, 'production' AS environment,
        CASE WHEN line_number % 2 = 0 THEN 'tail' ELSE 'kafka-stream' END AS source_name,
        CASE WHEN line_number % 2 = 1 AND line LIKE '{%}' THEN json_extract_string(line, '$.message') ELSE line END AS line FROM lines)""",
)
_add(
    "kafka_round_trip", _obs(),
    select="""SELECT id, source_id, template_id, event_ts, level, line_number, sample_hash FROM obs""",
)
_add("kafka_quarantine", _obs(where="event_id % 7 = 0"), select="SELECT id, 'invalid_message' AS reason FROM obs")
_add(
    "encode_messages", _obs(),
    select="SELECT application || '::' || environment AS key, count(*) AS messages, count(*) AS with_hash FROM obs GROUP BY ALL",
)
_add(
    "anomalies_through_topic", *_FOUND,
    select=_SLIM.replace("line_number", "line_number, application, environment, incident_number, status") + "found",
)
_add(
    "analyses_through_topic", *_FOUND, _VERDICTS,
    select="""SELECT id, anomaly_id, 'model-a' AS model, 'v2.0' AS prompt_version, severity, 'medium' AS confidence, investigate, summary,
      'cause' AS possible_causes, recommended_actions, ai_error, is_retryable, created_at FROM verdicts""",
)
_add(
    "unreadable_messages", *_FOUND, _VERDICTS,
    select="""SELECT 'anomalies' AS topic, 'invalid_message' AS reason, 3 * count(*) AS messages, count(*) AS cut_short FROM found
      UNION ALL SELECT 'analyses', 'invalid_message', 3 * count(*), count(*) FROM verdicts HAVING count(*) > 0""",
)
_add(
    "container_lines", _LINES,
    select="""SELECT line_number, 'cri' AS fmt, true AS matched, strftime(ingest_ts, '%Y-%m-%dT%H:%M:%S.%g') || '+00:00' AS time_text, 'stdout' AS stream,
        CAST(NULL AS VARCHAR) AS host, CAST(NULL AS VARCHAR) AS ident, CAST(NULL AS VARCHAR) AS pid, line AS log,
        date_trunc('millisecond', ingest_ts) AS event_ts FROM lines
      UNION ALL SELECT line_number, 'syslog', true, strftime(ingest_ts, '%b %d %H:%M:%S'), NULL, 'host-1', application, '77', line,
        date_trunc('second', ingest_ts) FROM lines
      UNION ALL SELECT line_number, 'docker', true, strftime(ingest_ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z', 'stderr', NULL, NULL, NULL, line,
        date_trunc('millisecond', ingest_ts) FROM lines""",
)
_add(
    "decode_cloudwatch", _LINES,
    select="""SELECT line_number // 20 AS payload_id, 'aws-group-' || (line_number // 20 % 3) AS application,
      'cloudwatch:/aws/group-' || (line_number // 20 % 3) AS source_name,
      'ingest-aws-group-' || (line_number // 20 % 3) || '-production' AS source_id, line AS message, epoch_us(ingest_ts) // 1000 AS timestamp_ms,
      'stream-1' AS stream, row_number() OVER (PARTITION BY line_number // 20 ORDER BY CAST(line_number AS VARCHAR)) AS line_number FROM lines""",
)
_FILES = """SELECT environment AS lang, count(*) AS lines, count(*) AS numbers, 1 AS first, count(*) AS last FROM docs GROUP BY ALL"""
_add("read_log_files", _DOCS, select=_FILES)
_add("read_compressed_logs", _DOCS, select=_FILES)

_add(
    "source_settings", _LINES,
    select="""SELECT CASE line_number % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'trace' ELSE 'dated' END AS source_id, 'app-' || source_id AS application,
      CASE line_number % 3 WHEN 0 THEN line WHEN 1 THEN 'job ' || line_number || ' stopped' || chr(10) || '   at step(' || line_number || ')' || chr(10) || '   at main'
        ELSE line || chr(10) || 'note of ' || line_number END AS record,
      CASE line_number % 3 WHEN 1 THEN TIMESTAMP '2024-01-31' ELSE CAST(stamp AS TIMESTAMP) END AS event_ts,
      CASE line_number % 3 WHEN 1 THEN 'UNKNOWN' ELSE level END AS level FROM (SELECT * EXCLUDE (source_id, application) FROM lines)""",
)

# --- streams -----------------------------------------------------------------------------------------------

_add(
    "stream_observations", _LINES,
    """parsed AS (SELECT *, line AS record, line LIKE '{%}' AS is_json, NULL AS attributes,
      CASE WHEN line LIKE '{%}' THEN json_extract_string(line, '$.message') ELSE line END AS message,
      CAST(stamp AS TIMESTAMP) AS event_ts FROM lines)""",
    _redacted("parsed", "message"), _mined(), _OBSERVED,
    select="SELECT id, template_id, sanitized_message, level, event_ts, client_id_hash FROM observed",
)
ORACLES["stream_duplicates"] = ORACLES["stream_observations"]
_add(
    "stream_buckets", _obs(), _counts(minutes=60),
    select=f"SELECT template_id || ':' || {_ISO} AS id, template_id, bucket_start, bucket_end, count, error_count FROM counts",
)
ORACLES["stream_late"] = ORACLES["stream_buckets"]
_SPANS = "spans AS (SELECT *, date_diff('day', DATE '2024-01-01', CAST(event_ts AS DATE)) // 5 AS span FROM obs)"
_SENT = "sent AS (FROM spans UNION ALL FROM spans WHERE span = (SELECT min(span) FROM spans))"
_TOTALS = f"SELECT template_id || ':' || {_ISO} AS id, template_id, bucket_start, bucket_end, count, error_count FROM counts"
_add("stream_late_repair", _obs(), _SPANS, _SENT, _counts("sent", 60), select=_TOTALS)
_add("stream_compacted", _obs(), _SPANS, _SENT, _counts("sent", 60), select=_TOTALS + " WHERE bucket_start >= TIMESTAMP '2024-01-21'")
# The batches: each span, then the first one again; late is what lies a day behind the latest event of earlier batches.
_DELIVERED = (
    _SPANS,
    """batches AS (SELECT span, row_number() OVER (ORDER BY again, span) - 1 AS batch, max(latest) OVER (ORDER BY again, span) AS seen_until,
      max(latest) OVER (ORDER BY again, span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 24 HOUR AS watermark FROM (
        SELECT span, 0 AS again, max(event_ts) AS latest FROM spans GROUP BY ALL
        UNION ALL SELECT span, 1, max(event_ts) FROM spans WHERE span = (SELECT min(span) FROM spans) GROUP BY ALL))""",
    f"""delivered AS (SELECT spans.*, batch, watermark, seen_until, coalesce({_bucket(60)} + INTERVAL 60 MINUTE <= watermark, false) AS late
      FROM spans JOIN batches USING (span))""",
)
_add("stream_late_rows", _obs(), *_DELIVERED, select="SELECT batch, id, template_id, level, event_ts FROM delivered WHERE late")
_add(
    "stream_metrics", _obs(), *_DELIVERED,
    select="""SELECT batch, watermark, seen_until, count(*) AS rows, count(*) FILTER (WHERE late) AS late_rows FROM delivered GROUP BY ALL""",
)
_add(
    "stream_clients", _DENSE,
    select=f"""SELECT template_id || ':' || {_ISO} AS id, count(DISTINCT client) AS clients, true AS close
      FROM (SELECT *, {_bucket(60)} AS bucket_start FROM obs) GROUP BY template_id, bucket_start""",
)
_add(
    "telemetry_stream", _obs(), *_DELIVERED,
    select="""SELECT (SELECT count(*) FROM obs) AS total_lines_read, (SELECT count(*) FROM delivered WHERE late) AS dropped_events,
      0 AS consumer_lag, (SELECT count(DISTINCT template_id) FROM obs) AS active_anomalies_count,
      (SELECT count(DISTINCT template_id) FROM obs) AS templates_count, (SELECT count(DISTINCT source_id) FROM obs) AS sources_count,
      (SELECT bool_or(late) FROM delivered) AS data_loss_warning""",
)
_add(
    "stream_anomalies", *_FOUND,
    select="SELECT id, anomaly_type, template_id, bucket_start, current_count, baseline_count, z_score FROM found",
)
_add(
    "stream_incident_numbers", *_FOUND,
    select="SELECT count(*) AS incidents, count(DISTINCT id) AS numbers, 1 AS lowest, count(*) AS highest FROM found",
)
_add(
    "stream_loss", *_FOUND, *_DELIVERED,
    f"lost AS (SELECT DISTINCT application, environment, {_bucket(60)} AS bucket_start FROM delivered WHERE late)",
    select="""SELECT id, anomaly_type, lost.bucket_start IS NOT NULL AS data_loss_warning
      FROM found LEFT JOIN lost ON lost.bucket_start = found.bucket_start""",
)
_add("stream_new_templates", _DENSE, _new(minutes=60), select="SELECT id, template_id, detected_at FROM fresh")
_add(
    "pipeline_anomalies", *_EVENT_MINED, _OBSERVED,
    "obs AS (SELECT * FROM observed)", _counts(minutes=60), _samples(), _RECENT.format(n=3), _RUNNING, _SPIKES, _new(minutes=60),
    select="""SELECT application, environment, anomaly_type, count(*) AS anomalies, count(DISTINCT template_id) AS templates FROM (
      SELECT application, environment, anomaly_type, template_id FROM bursts
      UNION ALL SELECT application, environment, anomaly_type, template_id FROM fresh) GROUP BY ALL""",
)

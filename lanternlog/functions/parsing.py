"""Column expressions that read one log record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanternlog.functions import times
from lanternlog.functions.binding import bind
from lanternlog.functions.levels import level_in_text, normalize_level

_BLANKS = " \t\r\n\f\x0b"

# The names under which JSON records carry time, level and message, by priority.
TIME_KEYS = ("timestamp", "time", "@timestamp", "ts")
LEVEL_KEYS = ("level", "severity", "log_level", "lvl")
MESSAGE_KEYS = ("message", "msg", "error", "log")

# Patterns that start a record, for common runtimes.
START_PRESETS = {
    "java": r"(?i)^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}[\.,]\d{3}",
    "python": r"^Traceback \(most recent call last\):",
}
# Lines that continue a record, for the same runtimes.
CONTINUATION_PRESETS = {
    "java": r"^\s+at\s.*|^\s+Caused by:.*|^\s+\.\.\.\s\d+\smore",
    "python": r"^\s+File\s.*|^\s+[A-Za-z0-9_]+Error:|^\s+[A-Za-z0-9_]+Exception:",
}


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def looks_like_json(text: Column) -> Column:
    trimmed = strip(text)
    return trimmed.startswith("{") & trimmed.endswith("}")


def starts_record(line: Column, pattern: str | Column | None = None, negate: bool | Column = True) -> Column:
    """Whether a line begins a record.

    With a pattern and ``negate``, lines that do not match continue the record before; with ``negate`` off,
    lines that do match continue it. Without a pattern a line starts a record unless it is indented or
    begins with ``Caused by:``; JSON and dated lines always start one.
    """
    guess = (
        looks_like_json(line)
        | line.rlike(times.ISO_START)
        | line.rlike(times.SYSLOG_START)
        | line.rlike(times.BRACKET_START)
        | ~(line.startswith(" ") | line.startswith("\t") | line.startswith("Caused by:"))
    )
    if pattern is None:
        return guess
    expression = F.lit(pattern) if isinstance(pattern, str) else pattern
    matches = F.rlike(line, expression)
    flips = F.lit(negate) if isinstance(negate, bool) else F.coalesce(negate, F.lit(True))
    by_pattern = F.when(flips, matches).otherwise(~matches)
    return F.when(expression.isNull(), guess).otherwise(by_pattern)


def json_attributes(record: Column, log_format: Column | None = None) -> Column:
    """Attributes of a JSON record; null when the record is text or broken JSON."""

    def read(text: Column) -> Column:
        candidate = text.startswith("{")
        claimed = text.endswith("}") if log_format is None else text.endswith("}") | (log_format == "json")
        return F.when(candidate & claimed, strict_object(text))

    return bind(strip(record), read)


def strict_object(text: Column) -> Column:
    """Fields of a JSON object as texts, null unless the whole text is one object.

    Spark's reader stops after the first value; as the only element of a list the rest of the text counts too.
    """
    options = {"allowSingleQuotes": "false"}
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>", options)
    return bind(listed, lambda rows: F.when(F.size(rows) == 1, F.get(rows, F.lit(0))))


def strict_variant(text: Column) -> Column:
    """JSON value of any kind, null unless the whole text is one value."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return bind(
        listed,
        lambda rows: F.when(
            F.try_variant_get(rows, "$[1]", "variant").isNull(), F.try_variant_get(rows, "$[0]", "variant")
        ),
    )


def first_filled(attributes: Column, names: tuple[str, ...]) -> Column:
    """First attribute among ``names`` that is neither missing nor empty."""
    values = F.array(*[F.try_element_at(attributes, F.lit(name)) for name in names])
    return F.get(F.filter(values, lambda v: v.isNotNull() & ~v.isin("", "[]", "{}", "false")), F.lit(0))


def json_time(attributes: Column) -> Column:
    return times.parse_timestamp(first_filled(attributes, TIME_KEYS))


def json_level(attributes: Column) -> Column:
    return normalize_level(first_filled(attributes, LEVEL_KEYS))


def json_message(attributes: Column, record: Column) -> Column:
    return F.coalesce(first_filled(attributes, MESSAGE_KEYS), strip(record))


def text_time(record: Column) -> Column:
    """Time at the start of a text record, bare or in brackets."""
    iso = F.nullif(F.regexp_extract(record, times.ISO_START, 0), F.lit(""))
    bracketed = F.nullif(F.regexp_extract(record, times.BRACKET_START, 1), F.lit(""))
    return times.parse_timestamp(F.coalesce(iso, bracketed))


def text_level(record: Column) -> Column:
    """Level word that follows the leading time, if the record has one."""
    body = F.regexp_replace(record, F.lit(f"(?:{times.ISO_START}|{times.BRACKET_START})"), F.lit(""))
    return level_in_text(body)


def parsed(record: Column, log_format: Column | None = None) -> Column:
    """Struct of attributes (null for text records), time, level and message of a record."""

    def of_json(attributes: Column) -> Column:
        return F.struct(
            attributes.alias("attributes"),
            json_time(attributes).alias("event_ts"),
            json_level(attributes).alias("level"),
            json_message(attributes, record).alias("message"),
        )

    of_text = F.struct(
        F.lit(None).cast("map<string,string>").alias("attributes"),
        text_time(record).alias("event_ts"),
        text_level(record).alias("level"),
        strip(record).alias("message"),
    )
    return bind(json_attributes(record, log_format), lambda a: F.when(a.isNotNull(), of_json(a)).otherwise(of_text))

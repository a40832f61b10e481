"""Severity names of log records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanternlog.schemas import ERROR_LEVELS

# Spellings that are accepted and the level each one means.
LEVEL_ALIASES = {
    "TRACE": "TRACE",
    "DEBUG": "DEBUG",
    "INFO": "INFO",
    "WARN": "WARN",
    "WARNING": "WARN",
    "ERR": "ERROR",
    "ERROR": "ERROR",
    "CRIT": "CRITICAL",
    "CRITICAL": "CRITICAL",
    "FATAL": "FATAL",
}
# Fixed value: level words looked for in free text.
LEVEL_WORDS = r"(?i)\b(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|CRITICAL|FATAL)\b"


def normalize_level(raw: Column) -> Column:
    """Level name for any accepted spelling, else ``UNKNOWN``."""
    word = F.upper(F.btrim(raw, F.lit(" \t\r\n\f\x0b")))
    known = F.create_map(*[F.lit(x) for pair in LEVEL_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.coalesce(word, F.lit(""))), F.lit("UNKNOWN"))


def level_in_text(text: Column) -> Column:
    """Level of the first level word in ``text``."""
    return normalize_level(F.regexp_extract(text, LEVEL_WORDS, 1))


def is_error(level: Column) -> Column:
    return level.isin(*ERROR_LEVELS)

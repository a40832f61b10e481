"""Masks that turn a sanitized message into its template signature."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternlog.functions.binding import bind

_MONTHS = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"


def _bounded(core: str) -> str:
    """``core`` where neither neighbour is a letter or digit."""
    return f"(?<![A-Za-z0-9])(?:{core})(?![A-Za-z0-9])"


# The masks in the order they apply, grouped by a cheap test that any match must pass.
REDACTION_MASKS = (
    (r"<EMAIL:[^>]+>", "EMAIL"),
    (r"<IP:[^>]+>", "IP"),
    (r"<CARD_NUM>", "CARD"),
    (r"<JWT_TOKEN>", "JWT"),
    (r"<BEARER_TOKEN>", "TOKEN"),
    (r"<REDACTED_SECRET>", "SECRET"),
    (r"<UUID>", "UUID"),
    (r"<IPV6>", "IP"),
    (r"<HEX_HASH>", "HASH"),
)
TIME_MASKS = (
    (r"\[?\d{4}[-\/\.]\d{1,2}[-\/\.]\d{1,2}[T ]\d{2}:\d{2}:\d{2}(?:[\.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?\]?", "TIMESTAMP"),
    (r"\[?\d{1,2}\/" + _MONTHS + r"\/\d{4}:\d{2}:\d{2}:\d{2}(?:\s+[+\-]\d{4})?\]?", "TIMESTAMP"),
    (r"\[?" + _MONTHS + r"\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}(?:[\.,]\d+)?\]?", "TIMESTAMP"),
    (r"\[?\b\d{4}[-\/\.]\d{1,2}[-\/\.]\d{1,2}\b\]?", "TIMESTAMP"),
    (r"\[?\b\d{2}:\d{2}:\d{2}(?:[\.,]\d+)?\b\]?", "TIMESTAMP"),
)
URL_MASKS = ((r"https?://[^\s\"'<>]+", "URL"),)
MAC_MASKS = ((_bounded(r"(?:[0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}"), "MAC"),)
IPV4_MASKS = ((_bounded(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d{1,5})?"), "IP"),)
IPV6_MASKS = ((_bounded(r"(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{1,4}|::1"), "IP"),)
HEX_MASKS = ((_bounded(r"0x[a-f0-9A-F]+"), "HEX"),)
UUID_MASKS = ((r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "UUID"),)
HASH_MASKS = ((_bounded(r"[0-9a-fA-F]{32,64}"), "HASH"),)
UNIT_MASKS = (
    (_bounded(r"\d+(?:\.\d+)?\s*(?:µs|us|ns|ms|s|sec|min|m)"), "DURATION"),
    (_bounded(r"\d+(?:\.\d+)?\s*(?:B|KB|MB|GB|TB|bytes|kb|mb|gb)"), "BYTES"),
)
PATH_MASKS = (
    (_bounded(r"/(?:[a-zA-Z0-9_\.\-]+/)*[a-zA-Z0-9_\.\-]+|[a-zA-Z]:(?:\\[a-zA-Z0-9_\.\-]+)+"), "PATH"),
)
NUMBER_MASKS = (
    (_bounded(r"[\-\+]?\d+\.\d+"), "NUM"),
    (_bounded(r"[\-\+]?\d+"), "NUM"),
)

_digit: Callable[[Column], Column] = lambda text: text.rlike("[0-9]")
GROUPS: tuple[tuple[Callable[[Column], Column], tuple[tuple[str, str], ...]], ...] = (
    (lambda t: t.contains("<"), REDACTION_MASKS),
    (_digit, TIME_MASKS),
    (lambda t: t.contains("http"), URL_MASKS),
    (lambda t: t.contains(":") | t.contains("-"), MAC_MASKS),
    (lambda t: _digit(t) & t.contains("."), IPV4_MASKS),
    (lambda t: t.contains(":"), IPV6_MASKS),
    (lambda t: t.contains("0x"), HEX_MASKS),
    (lambda t: t.contains("-"), UUID_MASKS),
    (lambda t: F.length(t) >= 32, HASH_MASKS),
    (_digit, UNIT_MASKS),
    (lambda t: t.contains("/") | t.contains("\\"), PATH_MASKS),
    (_digit, NUMBER_MASKS),
)
MASK_NAMES = tuple(dict.fromkeys(name for _, group in GROUPS for _, name in group))
PLACEHOLDER = "<(?:" + "|".join(MASK_NAMES) + r"|\*)>"


def first_line(message: Column) -> Column:
    """First line of a record without surrounding blanks."""
    return F.btrim(F.substring_index(message, "\n", 1), F.lit(" \t\r\n\f\x0b"))


def mask(message: Column, groups: tuple[tuple[Callable[[Column], Column], tuple[tuple[str, str], ...]], ...] = GROUPS) -> Column:
    """First line of a message with every variable part replaced by its mask name.

    Each group of masks runs behind its test, so plain prose skips nearly all of them.
    """
    text = first_line(message)
    for test, masks in groups:

        def step(t: Column, test: Callable = test, masks: tuple = masks) -> Column:
            masked = t
            for pattern, name in masks:
                masked = F.regexp_replace(masked, F.lit(pattern), F.lit(f"<{name}>"))
            return F.when(test(t), masked).otherwise(t)

        text = bind(text, step)
    return text


def with_masks(df: DataFrame, source: str, target: str) -> DataFrame:
    return df.withColumn(target, mask(F.col(source)))

"""Timestamps found in log records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanternlog.functions.binding import bind

# The shapes of a time at the start of a line.
ISO_START = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
BRACKET_START = r"^\[(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?)\]"
SYSLOG_START = r"^(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"


def parse_timestamp(raw: Column) -> Column:
    """UTC timestamp of an ISO-like or ``yyyy/MM/dd HH:mm:ss`` text, else null; no zone means UTC.

    The shape is checked first because a plain cast also accepts a bare year or a time of today.
    """

    def read(text: Column) -> Column:
        iso = F.regexp_replace(text, F.lit(r"[.,](\d{1,6})\d*"), F.lit(".$1"))
        iso = F.regexp_replace(iso, F.lit(r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(Z|[+-].*)?$"), F.lit("$1:00$2"))
        return (
            F.when(text.rlike(_ISO), iso.try_cast("timestamp"))
            .when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
            .when(text.rlike(r"^\d{4}/\d{1,2}/\d{1,2} "), F.try_to_timestamp(text, F.lit("yyyy/M/d HH:mm:ss")))
        )

    return bind(F.btrim(F.btrim(raw, F.lit(" \t\r\n\f\x0b")), F.lit("[]()")), read)

"""Line formats of container and system log collectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternlog.functions.parsing import json_attributes
from lanternlog.functions.times import parse_timestamp

# The line formats.
CRI = r"^([^ ]+) (stdout|stderr) ([^ ]*) (.*)$"
SYSLOG = (
    r"^\<([0-9]+)\>([^ ]* {1,2}[^ ]* [^ ]*) ([^ ]*) ([a-zA-Z0-9_\/\.\-]*)(?:\[([0-9]+)\])?(?:[^\:]*\:)? *(.*)$"
)


def _group(line: Column, pattern: str, index: int) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, index), F.lit(""))


def parse_container_lines(lines: DataFrame, fmt: str, column: str = "line", year: Column | None = None) -> DataFrame:
    """Add the fields of a collector format: ``docker`` (JSON), ``cri`` or ``syslog``; ``matched`` tells if the line fits.

    Syslog times have no year: ``year`` supplies it, otherwise the time stays text.
    """
    line = F.col(column)
    null = F.lit(None).cast("string")
    if fmt == "docker":
        row = json_attributes(line)
        get = lambda name: F.try_element_at(row, F.lit(name))
        fields = {"time_text": get("time"), "stream": get("stream"), "log": F.rtrim(get("log"), F.lit("\n"))}
        matched = row.isNotNull()
    elif fmt == "cri":
        fields = {
            "time_text": _group(line, CRI, 1), "stream": _group(line, CRI, 2), "logtag": _group(line, CRI, 3),
            "log": _group(line, CRI, 4),
        }
        matched = line.rlike(CRI)
    elif fmt == "syslog":
        fields = {
            "pri": _group(line, SYSLOG, 1), "time_text": _group(line, SYSLOG, 2), "host": _group(line, SYSLOG, 3),
            "ident": _group(line, SYSLOG, 4), "pid": _group(line, SYSLOG, 5), "log": _group(line, SYSLOG, 6),
        }
        matched = line.rlike(SYSLOG)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    out = lines.select(
        "*",
        matched.alias("matched"),
        *[fields.get(n, null).alias(n) for n in ("time_text", "stream", "logtag", "pri", "host", "ident", "pid", "log")],
    )
    if fmt == "syslog":
        if year is None:
            return out.withColumn("event_ts", F.lit(None).cast("timestamp"))
        dated = F.concat_ws(" ", year.cast("string"), F.regexp_replace("time_text", " +", " "))
        return out.withColumn("event_ts", F.try_to_timestamp(dated, F.lit("yyyy MMM d HH:mm:ss")))
    return out.withColumn("event_ts", parse_timestamp(F.col("time_text")))

"""Source definitions as a small table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lanternlog.functions.parsing import CONTINUATION_PRESETS, START_PRESETS
from lanternlog.schemas import SOURCES


def normalize_source(definition: dict[str, Any]) -> dict[str, Any]:
    """One definition with defaults filled and the nested ``multiline`` block flattened.

    A block names its own ``pattern``, or by ``start`` or ``continuation`` a runtime whose records start, or go on, in a known way.
    """
    row = dict(definition)
    for name in ("id", "application", "environment", "path"):
        if not str(row.get(name) or "").strip():
            raise ValueError(f"source {row.get('id')!r} has no {name}")
    block = row.pop("multiline", None)
    if isinstance(block, dict):
        pattern, negate = block.get("pattern"), block.get("negate", True)
        if block.get("start"):
            pattern, negate = START_PRESETS[block["start"]], True
        elif block.get("continuation"):
            pattern, negate = CONTINUATION_PRESETS[block["continuation"]], False
        row.setdefault("multiline_pattern", pattern)
        row.setdefault("multiline_negate", negate)
    defaults = {"format": "auto", "multiline_negate": True, "enabled": True}
    return {name: row.get(name, defaults.get(name)) for name in SOURCES.fieldNames()}


def load_sources(
    spark: SparkSession, definitions: list[dict[str, Any]], enabled_only: bool = True
) -> DataFrame:
    """Table of validated sources."""
    rows = [normalize_source(d) for d in definitions]
    if enabled_only:
        rows = [r for r in rows if r["enabled"]]
    return spark.createDataFrame([tuple(r.values()) for r in rows], SOURCES)


def read_sources(spark: SparkSession, path: str, enabled_only: bool = True) -> DataFrame:
    """Sources of a YAML file with a ``sources`` list."""
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("reading YAML needs PyYAML; pass the definitions to load_sources instead") from error
    text = "\n".join(row.value for row in spark.read.text(path, wholetext=True).take(1))
    return load_sources(spark, (yaml.safe_load(text) or {}).get("sources", []), enabled_only)

"""Registered queries against their SQL. LANTERN_ALL=1 runs every one of them."""

from __future__ import annotations

import os

import __spark_entry__ as entry
from lanternlog.plans.queries import REGISTRY
import pytest
from compare import compare, connect

SF = os.environ.get("LANTERN_SF", "/root/testdata/sf0.001")
FAST = (
    "bucket_timeline", "bucket_rollup", "baseline_zscore", "recent_samples", "parse_events", "redact_documents", "sanitize_attributes",
    "mask_documents", "observations", "new_templates", "correlated_anomalies", "field_combinations", "template_detail", "merge_templates",
    "upsert_sources", "embed_documents", "similar_vectors", "chat_window", "rejected_envelopes", "decode_kafka_raw", "read_log_files",
    "redact_secrets", "mask_secrets", "source_settings",
)
NAMES = list(entry.queries()) if os.environ.get("LANTERN_ALL") else FAST


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, connection, name):
    outcome, rows, _ = compare(spark, connection, name, SF)
    assert outcome in ("ok", "no sql"), outcome
    assert rows >= 0


def test_every_query_is_listed():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    own = {"mine_templates_drain", "mine_documents_drain", "similar_vectors_lsh"}
    assert REGISTRY.keys() - entry.oracle_sql().keys() == own


def test_entry(spark):
    assert entry.entry(spark).count() > 0

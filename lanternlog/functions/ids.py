"""Deterministic identifiers and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SALT = "lantern"


def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)


def template_id(pattern: Column, application: Column, environment: Column) -> Column:
    """``tmpl_`` plus 12 hex digits over application, environment and trimmed pattern."""
    key = F.concat_ws(":", application, environment, F.btrim(pattern, F.lit(" \t\r\n\f\x0b")))
    return F.concat(F.lit("tmpl_"), F.substring(sha256_hex(key), 1, 12))


def pseudonym(value: Column, salt: str = DEFAULT_SALT) -> Column:
    """First 8 hex digits of the salted hash; pass the deployment's salt to keep pseudonyms stable."""
    return F.substring(sha256_hex(F.concat(F.lit(salt), value)), 1, 8)


def client_hash(value: Column) -> Column:
    """Unsalted hash of a client identifier, null for blank input."""
    return F.when(F.btrim(value, F.lit(" \t\r\n\f\x0b")) != "", sha256_hex(value))


def row_id(*parts: Column) -> Column:
    """Identifier of a row from its natural key, so that a re-run writes the same ids."""
    texts = [F.coalesce(part.cast("string"), F.lit("")) for part in parts]
    return sha256_hex(F.concat_ws("|", *texts))


def bucket_id(template: Column, bucket_start: Column) -> Column:
    """Upsert key of a bucket: template id and ISO start time in UTC."""
    return F.concat(template, F.lit(":"), F.date_format(bucket_start, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))

"""Rules that remove secrets and personal data from text.

The rules run in the order of ``RULES``; each one sees the text the rule before it left.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternlog.functions.binding import bind
from lanternlog.functions.ids import DEFAULT_SALT, client_hash, pseudonym

# The patterns of sensitive tokens.
JWT = r"\beyJ[A-Za-z0-9-_=]+\.[A-Za-z0-9-_=]+\.?[A-Za-z0-9-_.+/=]*\b"
BEARER = r"(?i)\bBearer\s+([A-Za-z0-9\-_.~+/]+=*)"
SECRET = (
    r"(?i)((?:api[_-]?key|apikey|secret|access[_-]?token|password|auth[_-]?token)\s*[:=]\s*[\"']?)"
    r"([^\"'\s,;]+)([\"']?)"
)
CARD = r"\b(?:\d{4}[- ]?){3}\d{4}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
IPV6 = r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"
HEX = r"\b[0-9a-fA-F]{32,64}\b"

# Attribute names that identify a client, and attribute names that may be kept.
CLIENT_KEYS = ("client_id", "clientid", "customer_id", "customerid", "account_id", "accountid")
SAFE_KEYS = (
    "service", "host", "hostname", "container", "request_id", "trace_id", "http_status", "status", "error_code",
)


def _replace_with(pattern: str, replacement: str) -> Callable[[Column, str], Column]:
    return lambda text, salt: F.regexp_replace(text, F.lit(pattern), F.lit(replacement))


def _replace_with_pseudonym(pattern: str, name: str) -> Callable[[Column, str], Column]:
    """Each match becomes its own salted pseudonym: the parts between the matches are zipped with them."""

    def rewrite(text: Column, salt: str) -> Column:
        between = F.split(text, pattern, -1)
        marks = F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda found: F.concat(F.lit(f"<{name}:"), pseudonym(found, salt), F.lit(">")),
        )
        return F.array_join(
            F.zip_with(between, marks, lambda part, mark: F.concat(part, F.coalesce(mark, F.lit("")))), ""
        )

    return rewrite


@dataclass(frozen=True)
class Rule:
    """``guard`` is a cheap test that any text the pattern can match must pass."""

    tag: str
    pattern: str
    guard: Callable[[Column], Column]
    rewrite: Callable[[Column, str], Column]


def _has(*literals: str) -> Callable[[Column], Column]:
    def test(text: Column) -> Column:
        found = text.contains(literals[0])
        for literal in literals[1:]:
            found = found | text.contains(literal)
        return found

    return test


_has_digit = lambda text: text.rlike("[0-9]")

RULES = (
    Rule("JWT", JWT, _has("eyJ"), _replace_with(JWT, "<JWT_TOKEN>")),
    Rule("BEARER_TOKEN", BEARER, lambda t: F.lower(t).contains("bearer"), _replace_with(BEARER, "Bearer <BEARER_TOKEN>")),
    Rule("SECRET_KEY", SECRET, _has(":", "="), _replace_with(SECRET, "$1<REDACTED_SECRET>$3")),
    Rule("CREDIT_CARD", CARD, _has_digit, _replace_with(CARD, "<CARD_NUM>")),
    Rule("EMAIL", EMAIL, _has("@"), _replace_with_pseudonym(EMAIL, "EMAIL")),
    Rule("UUID", UUID, _has("-"), _replace_with(UUID, "<UUID>")),
    Rule("IPV4", IPV4, _has("."), _replace_with_pseudonym(IPV4, "IP")),
    Rule("IPV6", IPV6, _has(":"), _replace_with(IPV6, "<IPV6>")),
    Rule("HEX_HASH", HEX, lambda t: F.length(t) >= 32, _replace_with(HEX, "<HEX_HASH>")),
)


def redact_rule(text: Column, tag: str, salt: str = DEFAULT_SALT) -> Column:
    """Apply the one rule with this tag."""
    rule = next(r for r in RULES if r.tag == tag)
    return rule.rewrite(text, salt)


def redact_value(text: Column, salt: str = DEFAULT_SALT) -> Column:
    """Text after all rules."""
    for rule in RULES:
        text = bind(text, lambda t, rule=rule: F.when(rule.guard(t), rule.rewrite(t, salt)).otherwise(t))
    return text


def redact(text: Column, salt: str = DEFAULT_SALT) -> Column:
    """Struct of the text after all rules and the sorted tags of those that matched.

    A text that fails a guard costs no regular expression, and only a text that matched is rewritten.
    """
    state = F.struct(text.alias("text"), F.array().cast("array<string>").alias("tags"))
    for rule in RULES:

        def step(s: Column, rule: Rule = rule) -> Column:
            hit = rule.guard(s["text"]) & s["text"].rlike(rule.pattern)
            changed = F.struct(
                rule.rewrite(s["text"], salt).alias("text"), F.array_append(s["tags"], F.lit(rule.tag)).alias("tags")
            )
            return F.when(hit, changed).otherwise(s)

        state = bind(state, step)
    return bind(state, lambda s: F.struct(s["text"].alias("text"), F.array_sort(s["tags"]).alias("tags")))


def with_redaction(
    df: DataFrame, source: str, target: str, tags: str = "redaction_types", salt: str = DEFAULT_SALT
) -> DataFrame:
    """Replace ``source`` by its redacted text ``target`` and the tags of the rules that matched."""
    rest = [c for c in df.columns if c not in (source, target, tags)]
    clean = df.select(*rest, redact(F.col(source), salt).alias("_clean"))
    return clean.select(*rest, F.col("_clean.text").alias(target), F.col("_clean.tags").alias(tags))


def _normalized(entries: Column) -> Column:
    return F.transform(
        entries, lambda e: F.struct(F.replace(F.lower(e["key"]), F.lit("-"), F.lit("_")).alias("k"), e["value"].alias("v"))
    )


def client_id_hash(attributes: Column) -> Column:
    """Hash of the client identifier among the attributes; the last one wins."""
    clients = F.filter(_normalized(F.map_entries(attributes)), lambda e: e["k"].isin(*CLIENT_KEYS))
    return client_hash(F.try_element_at(clients, F.lit(-1))["v"])


def safe_attributes(attributes: Column, salt: str = DEFAULT_SALT) -> Column:
    """Allow-listed attributes under normalised names, each value redacted again; everything else is dropped."""
    kept = F.filter(
        _normalized(F.map_entries(attributes)), lambda e: e["k"].isin(*SAFE_KEYS) & e["v"].isNotNull()
    )

    # The last spelling of a name wins, as when the entries are written one after the other.
    def last_of_each(entries: Column) -> Column:
        return F.filter(
            entries,
            lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"]),
        )

    pairs = F.transform(
        bind(kept, last_of_each), lambda e: F.struct(e["k"].alias("key"), redact_value(e["v"], salt).alias("value"))
    )
    return F.coalesce(F.map_from_entries(pairs), F.create_map().cast("map<string,string>"))


def merge_source_metadata(metadata: Column, defaults: dict[str, Column]) -> Column:
    """Fill names the event does not carry with the non-blank values of its source."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in defaults.items()])
    missing = F.filter(
        entries,
        lambda e: e["value"].isNotNull() & (e["value"] != "") & ~F.map_contains_key(metadata, e["key"]),
    )
    return F.map_concat(metadata, F.map_from_entries(missing))

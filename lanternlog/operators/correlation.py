"""Signals that need more than one template: correlated anomalies and unusual combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternlog.functions.ids import row_id
from lanternlog.operators import buckets as bk
from lanternlog.session import stored


def correlate_anomalies(anomalies: DataFrame, minutes: int = 5, min_sources: int = 2) -> DataFrame:
    """Windows of an application and environment whose anomalies come from several sources.

    The members stay in the anomaly table; ``correlation_members`` joins them to their group.
    """
    keys = ("application", "environment", "window_start")
    flat = anomalies.withColumn("window_start", F.window("bucket_start", f"{minutes} minutes")["start"]).select(
        *keys, "id", "template_id", "anomaly_type", "z_score", F.explode("source_paths").alias("source_path")
    )
    return (
        flat.groupBy(*keys)
        .agg(
            F.count_distinct("source_path").alias("sources"),
            F.count_distinct("template_id").alias("templates"),
            F.count_distinct("id").alias("anomalies"),
            F.count_distinct("anomaly_type").alias("types"),
            F.max("z_score").alias("max_z_score"),
        )
        .where(F.col("sources") >= min_sources)
        .withColumn("group_id", row_id(F.col("application"), F.col("environment"), F.unix_micros("window_start")))
    )


def correlation_members(anomalies: DataFrame, groups: DataFrame, minutes: int = 5) -> DataFrame:
    """Anomalies with the group they belong to."""
    placed = anomalies.withColumn("window_start", F.window("bucket_start", f"{minutes} minutes")["start"])
    keys = ["application", "environment", "window_start"]
    return placed.join(groups.select(*keys, "group_id"), keys)


def unusual_field_combinations(
    observations: DataFrame, fields: tuple[str, ...] = ("http_status", "error_code"), max_share: float = 0.05
) -> DataFrame:
    """Combinations of attribute values that are rare within their application and environment.

    A field that no record of a row carries is a null of the combination; rows without any are left out.
    """
    values = [F.try_element_at("metadata", F.lit(field)).alias(field) for field in fields]
    present = observations.select("application", "environment", *values).where(
        F.coalesce(*[F.col(field) for field in fields]).isNotNull()
    )
    combinations = present.groupBy("application", "environment", *fields).agg(F.count(F.lit(1)).alias("rows"))
    totals = combinations.groupBy("application", "environment").agg(F.sum("rows").alias("total"))
    return (
        combinations.join(totals, ["application", "environment"])
        .withColumn("share", F.col("rows") / F.col("total"))
        .where(F.col("share") <= max_share)
    )


def _fingerprint(value: Column) -> Column:
    """Number whose sum over a set identifies the set, whatever the order of its members."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("decimal(38,0)")


def template_combinations(observations: DataFrame, minutes: int = 5) -> DataFrame:
    """The set of templates seen together per bucket of an application and environment.

    A set is represented by the sum of its members' hashes, so neither sets nor pairs are ever gathered.
    """
    keys = ("application", "environment", "bucket_start")
    distinct = (
        bk.with_bucket(observations.select("application", "environment", "event_ts", "template_id", "source_id"), minutes)
        .groupBy(*keys, "template_id", "source_id")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    once = distinct.groupBy(*keys, "template_id").agg(
        F.max("source_id").alias("_high"), F.min("source_id").alias("_low"), F.sum("rows").alias("rows")
    )
    return once.groupBy(*keys).agg(
        F.sum(_fingerprint(F.col("template_id"))).cast("string").alias("combination"),
        F.count(F.lit(1)).alias("templates"),
        F.sum("rows").alias("rows"),
        (F.max("_high") != F.min("_low")).alias("across_sources"),
    )


def unusual_template_combinations(
    observations: DataFrame, minutes: int = 5, min_templates: int = 2, max_share: float = 0.05
) -> DataFrame:
    """Buckets whose set of templates occurs in few buckets of the application and environment."""
    sets = template_combinations(observations, minutes)
    scope = ["application", "environment"]
    support = sets.groupBy(*scope, "combination").agg(F.count(F.lit(1)).alias("buckets"))
    totals = support.groupBy(*scope).agg(F.sum("buckets").alias("total"))
    share = F.col("buckets") / F.col("total")
    rare = support.join(totals, scope).withColumn("share", share).where(F.col("share") <= max_share)
    return sets.where(F.col("templates") >= min_templates).join(
        rare.select(*scope, "combination", "buckets", "share"), [*scope, "combination"]
    )


_SCOPE = ["application", "environment"]


def _seen_buckets(observations: DataFrame, minutes: int) -> DataFrame:
    """Every template once per bucket it occurs in, with the lowest and highest of its sources there."""
    flat = bk.with_bucket(observations.select(*_SCOPE, "event_ts", "template_id", "source_id"), minutes)
    seen = flat.groupBy(*_SCOPE, "bucket_start", "template_id").agg(F.min("source_id").alias("low"), F.max("source_id").alias("high"))
    return stored(seen.where(F.col("template_id").isNotNull()), "seen-buckets")


def template_classes(observations: DataFrame, minutes: int = 5, min_together: int = 3, min_lift: float = 3.0) -> DataFrame:
    """(application, environment, template_id, class_id, buckets, total): templates that may have unusual partners.

    A pair cannot be seen together oftener than its rarer template, and its lift is at most the number of buckets over the
    count of its commoner one; templates outside these bounds have no partner. Templates seen in the same buckets from the same
    sources are one class, named after its smallest id, so a burst of thousands of templates is one row in what follows.
    """
    return _classes(_seen_buckets(observations, minutes), min_together, min_lift)


def _classes(seen: DataFrame, min_together: int, min_lift: float) -> DataFrame:
    totals = seen.select(*_SCOPE, "bucket_start").distinct().groupBy(*_SCOPE).agg(F.count(F.lit(1)).alias("total"))
    place = F.concat_ws("|", F.unix_micros("bucket_start").cast("string"), F.coalesce("low", F.lit("")), F.coalesce("high", F.lit("")))
    counted = seen.groupBy(*_SCOPE, "template_id").agg(F.count(F.lit(1)).alias("buckets"), F.sum(_fingerprint(place)).alias("_set"))
    bounded = counted.join(totals, _SCOPE).where(
        (F.col("buckets") >= min_together) & (F.col("buckets") * F.lit(float(min_lift)) <= F.col("total"))
    )
    names = bounded.groupBy(*_SCOPE, "buckets", "_set").agg(F.min("template_id").alias("class_id"))
    joined = bounded.join(names, [*_SCOPE, "buckets", "_set"]).drop("_set")
    return stored(joined.select(*_SCOPE, "template_id", "class_id", "buckets", "total"), "template-classes")


def pair_candidates(rows: DataFrame, min_together: int, min_lift: float) -> DataFrame:
    """Pairs of classes that may be together in enough buckets, from (scope, bucket, class, buckets, total).

    The buckets of a class are numbered from the emptiest on. Classes that share k buckets share one before the last k - 1 of each, so
    crowded buckets are left out where they can be; and what follows the first shared bucket must leave room for the count
    that support and lift ask for.
    """
    crowd = rows.groupBy(*_SCOPE, "bucket_start").agg(F.count(F.lit(1)).alias("_crowd"))
    order = W.partitionBy(*_SCOPE, "class_id").orderBy("_crowd", "bucket_start")
    placed = rows.join(crowd, [*_SCOPE, "bucket_start"]).withColumn("place", F.row_number().over(order))
    index = stored(placed.where(F.col("place") <= F.col("buckets") - (min_together - 1)).drop("_crowd"), "pair-index")
    a, b = index.alias("a"), index.alias("b")
    same = F.expr(" and ".join(f"a.{c} = b.{c}" for c in (*_SCOPE, "bucket_start")))
    need = F.expr(f"greatest({min_together}, ceil({float(min_lift)}D * a.buckets * b.buckets / a.total - 1e-9))")
    room = F.expr("1 + least(a.buckets - a.place, b.buckets - b.place)")
    pairs = a.join(b, same & F.expr("a.class_id < b.class_id") & (room >= need))
    return pairs.select(
        *[F.col(f"a.{c}").alias(c) for c in _SCOPE], F.col("a.class_id").alias("left_id"), F.col("b.class_id").alias("right_id")
    ).distinct()


def unusual_template_pairs(
    observations: DataFrame, minutes: int = 5, min_together: int = 3, min_lift: float = 3.0
) -> DataFrame:
    """Pairs of templates that appear together, from different sources, far oftener than their own counts suggest.

    Two templates are together in a bucket of an application and environment unless both came from one and the same source there.
    With counts n1 and n2 and N buckets, the lift of ``together`` is together * N / (n1 * n2). Pairs are of classes
    (``template_classes``), each with its number of templates; a class of several templates seen from several sources is also a
    pair with itself. Candidates come from an index of sparse buckets; only they are counted exactly.
    """
    seen = _seen_buckets(observations, minutes)
    classes = _classes(seen, min_together, min_lift)
    sizes = classes.groupBy(*_SCOPE, "class_id", "buckets", "total").agg(F.count(F.lit(1)).alias("templates"))
    rows = stored(
        seen.withColumnRenamed("template_id", "class_id").join(sizes, [*_SCOPE, "class_id"]), "class-buckets"
    )
    candidates = pair_candidates(rows.select(*_SCOPE, "bucket_start", "class_id", "buckets", "total"), min_together, min_lift)
    left = rows.select(
        *_SCOPE, F.col("class_id").alias("left_id"), "bucket_start", F.col("low").alias("_low"), F.col("high").alias("_high"),
        F.col("buckets").alias("left_buckets"), F.col("templates").alias("left_templates"), "total",
    )
    right = rows.select(
        *_SCOPE, F.col("class_id").alias("right_id"), "bucket_start", "low", "high",
        F.col("buckets").alias("right_buckets"), F.col("templates").alias("right_templates"),
    )
    one_source = F.expr("_low <=> _high and low <=> high and _low <=> low")
    counts = ["total", "left_buckets", "right_buckets", "left_templates", "right_templates"]
    others = (
        candidates.join(left, [*_SCOPE, "left_id"]).join(right, [*_SCOPE, "right_id", "bucket_start"])
        .groupBy(*_SCOPE, "left_id", "right_id", *counts).agg(F.count_if(~one_source).alias("together"))
    )
    alone = rows.where(F.col("templates") > 1).groupBy(*_SCOPE, "class_id", "total", "buckets", "templates").agg(
        F.count_if(~F.col("low").eqNullSafe(F.col("high"))).alias("together")
    ).select(
        *_SCOPE, F.col("class_id").alias("left_id"), F.col("class_id").alias("right_id"), "total",
        *[F.col(c).alias(f"{side}_{c}") for c in ("buckets", "templates") for side in ("left", "right")], "together",
    )
    lift = F.col("together") * F.col("total") / (F.col("left_buckets") * F.col("right_buckets"))
    found = others.unionByName(alone).withColumn("lift", lift)
    return found.where((F.col("together") >= min_together) & (F.col("lift") >= min_lift))

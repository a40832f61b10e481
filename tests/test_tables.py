"""Ranking, detection, memory, clustering, merges and retention on small tables."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternlog.operators import buckets as bk
from lanternlog.operators import clustering, incidents, memory, merges, retention, triage, vector_lists, versions
from lanternlog.operators import detection as dt
from lanternlog.operators.ranking import exact_rank, first_rows, lookup_join
from lanternlog.schemas import OBSERVATION_ORDER, OBSERVATIONS, TEMPLATE_VERSIONS
from lanternlog.session import new_path

START = datetime(2024, 1, 1)


def observations(spark, rows):
    """Rows of (template, seconds, level, path, line)."""
    data = [
        (f"{i}", "src", "app", "prod", t, t, f"message {i % 9}", level, START + timedelta(seconds=s), START, path, line, [], f"h{i % 9}", None, {}, [])
        for i, (t, s, level, path, line) in enumerate(rows)
    ]
    return spark.createDataFrame(data, OBSERVATIONS)


def test_exact_rank_on_a_hot_slot(spark):
    random.seed(3)
    rows = [(f"t{random.random() < 0.2:d}", random.choice([5, 5, 5, 5, 61.5, 62.25]), "INFO", f"/f{random.randrange(3)}", n) for n in range(600)]
    df = bk.with_bucket(observations(spark, rows))
    window = W.partitionBy("template_id", "bucket_start").orderBy(*OBSERVATION_ORDER)
    want = {r.id: r.n for r in df.select("id", F.row_number().over(window).alias("n")).collect()}
    for hot in (1_000_000, 20):
        assert {r.id: r.running_count for r in bk.running_bucket_count(df, hot_rows=hot).collect()} == want
    fine = exact_rank(df, ["template_id"], OBSERVATION_ORDER, F.date_trunc("minute", "event_ts"), hot_rows=10, fine=[F.col("event_ts"), F.col("source_path")])
    by_template = W.partitionBy("template_id").orderBy(*OBSERVATION_ORDER)
    wide = {r.id: r.n for r in df.select("id", F.row_number().over(by_template).alias("n")).collect()}
    assert {r.id: r["rank"] for r in fine.collect()} == wide
    first = {r.id for r in df.withColumn("n", F.row_number().over(by_template)).where("n = 1").collect()}
    for limit in (100, 0):
        assert {r.id for r in first_rows(df, ["template_id"], "event_ts", OBSERVATION_ORDER, limit).collect()} == first


def test_lookup_join_deals_out_hot_keys(spark):
    big = spark.range(1000).select("id", F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 40).alias("k"))
    small = big.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.max("id").alias("high"))
    want = {(r.id, r.k, r.high) for r in big.join(small, "k").collect()}
    for limit in (1000, 0):
        got = lookup_join(big, small, ["k"], "rows", ["id"], broadcast_rows=limit, hot_keys=20).collect()
        assert {(r.id, r.k, r.high) for r in got} == want and len(got) == 1000


def brute_force_triggers(rows, limits):
    """Replay the observations one by one against the buckets before."""
    width = limits.bucket_minutes * 60
    totals, ordered = {}, sorted(rows, key=lambda r: (r[0], r[1]))
    for t, s, *_ in rows:
        totals.setdefault(t, {}).setdefault(int(s // width), 0)
        totals[t][int(s // width)] += 1
    fired, seen = {}, {}
    for t, s, level, *_ in ordered:
        bucket = int(s // width)
        seen[t, bucket] = n = seen.get((t, bucket), 0) + 1
        history = [c for b, c in sorted(totals[t].items()) if b < bucket][-limits.history :]
        if n < limits.min_count or len(history) < limits.min_history or (t, bucket) in fired:
            continue
        mean, std = float(np.mean(history)), float(np.std(history))
        z = (n - mean) / std if std > 0 else (4.0 if n > mean * 3 + 5 else 0.0)
        if z >= limits.z_score:
            fired[t, bucket] = ("error_burst" if level in ("ERROR", "FATAL", "CRITICAL") else "frequency_spike", n, round(z, 2))
    return fired


def test_spikes_equal_a_replay(spark):
    random.seed(5)
    rows, line = [], 0
    for t in ("a", "b", "flat"):
        for bucket in range(20):
            count = 2 if t == "flat" else random.randrange(1, 5)
            count += random.choice([0] * 9 + [60])
            for _ in range(count):
                line += 1
                rows.append((t, bucket * 300 + random.randrange(300) + line / 1e4, random.choice(["ERROR", "INFO", "FATAL"]), "/f", line))
    limits = dt.Thresholds()
    got = dt.detect_spikes(observations(spark, rows)).collect()
    found = {(r.template_id, int((r.bucket_start - START).total_seconds() // 300)): (r.anomaly_type, r.current_count, r.z_score) for r in got}
    assert found == brute_force_triggers(rows, limits) and len(found) >= 3


def test_new_templates_and_numbers(spark):
    df = observations(spark, [("a", 9, "INFO", "/f", 1), ("a", 3, "INFO", "/f", 2), ("b", 4, "ERROR", "/f", 3)])
    known = spark.createDataFrame([("b",)], "id string")
    found = dt.detect(df, known).collect()
    assert [(r.template_id, r.current_count, r.z_score, r.incident_number) for r in found] == [("a", 1, None, "INC0000001")]
    assert found[0].evidence_references[0].line_number == 2
    numbers = {r.incident_number for r in dt.detect(df, start_at=41).collect()}
    assert numbers == {"INC0000041", "INC0000042"}


def test_cap_and_related(spark):
    df = observations(spark, [(f"t{i}", i, "INFO", "/f", i) for i in range(30)])
    found = dt.detect_new_templates(df)
    capped = dt.cap_batches(found, size=10, seconds=60).collect()
    assert sum(r.in_batch for r in capped) == 10 and sum(r.status == "failed" for r in capped) == 20
    related = incidents.related_anomalies(found, ("application", "environment")).collect()
    assert all(len(r.related) == 10 and r.id not in [o.id for o in r.related] for r in related)


def test_search_paths_agree_with_numpy(spark, monkeypatch):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(300, 8)).astype(np.float32)
    vectors[5] = 0
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(999, [1.0, 2.0])], "id long, embedding array<float>")
    queries = corpus.where("id < 300").withColumnRenamed("id", "query_id")
    wide = vectors.astype(np.float64)
    lengths = np.linalg.norm(wide, axis=1)
    with np.errstate(invalid="ignore"):
        scores = np.nan_to_num(wide @ wide.T / np.outer(lengths, lengths))
    want = set()
    for q in range(300):
        order = sorted((i for i in range(300) if i != q and scores[q, i] >= 0.3), key=lambda i: (-round(scores[q, i], 4), i))
        want |= {(q, i, n + 1) for n, i in enumerate(order[:5])}
    key = lambda df: {(r.query_id, r.id, r["rank"]) for r in df.collect()}
    assert key(memory.search_similar(queries, corpus, 5, 0.3, self_match=False)) == want
    for block in (vector_lists.LIST_BLOCK, 20):
        monkeypatch.setattr(vector_lists, "LIST_BLOCK", block)
        monkeypatch.setattr(vector_lists, "QUERY_BLOCK", block)
        assert key(memory.search_similar(queries, corpus, 5, 0.3, self_match=False, query_block=64)) == want
    lists = vector_lists.audited(queries, vector_lists.build_lists(corpus), 5, 0.3, self_match=False, recall=0.9)
    near = vector_lists.search_lists(queries, lists, 5, 0.3, self_match=False).collect()
    assert len({(r.query_id, r.id) for r in near} & {(q, i) for q, i, _ in want}) >= 0.8 * len(want)
    assert all(abs(r.score - scores[r.query_id, r.id]) < 1e-4 for r in near)
    assert sum(n.sum() for n in lists.sizes.values()) == 301
    assert memory.search_similar_approx(queries, corpus.where("id < 0")).count() == 0


def test_pruned_search_visits_few_lists_of_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    vectors = (centres[np.arange(1000) % 20] + 0.05 * rng.normal(size=(1000, 16))).astype(np.float32)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<float>")
    queries = corpus.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    lists = vector_lists.audited(queries, vector_lists.build_lists(corpus, 20), 5, 0.5)
    assert vector_lists.compared_pairs(queries, lists) < 50 * 1000 / 4
    key = lambda df: {(r.query_id, r.id, r.score) for r in df.collect()}
    assert key(vector_lists.search_exact(queries, lists, 5, 0.5)) == key(memory.search_similar(queries, corpus, 5, 0.5))


def test_leases_end(spark):
    now = F.lit(datetime(2024, 1, 31)).cast("timestamp")
    at = lambda minutes: F.lit(datetime(2024, 1, 31) + timedelta(minutes=minutes))
    found = dt.detect_new_templates(observations(spark, [(f"t{i}", i, "INFO", "/f", i) for i in range(4)])).orderBy("template_id")
    ids = [r.id for r in found.collect()]
    one = lambda i: found.where(F.col("id") == ids[i])
    leases = triage.take_leases(one(0), at(-1)).unionByName(triage.take_leases(one(1), at(-9))).unionByName(triage.take_leases(one(2), at(-2)))
    verdicts = triage.heuristic_triage(one(2)).withColumn("created_at", at(-1).cast("timestamp"))
    feedback = spark.createDataFrame([], "anomaly_id string, action string")
    status = lambda moment: {r.id: r.status for r in triage.status_lifecycle(found, verdicts, feedback, leases, moment).collect()}
    assert [status(now)[i] for i in ids] == ["analyzing", "active", "analyzed", "active"]
    later = now + F.expr("INTERVAL 10 MINUTES")
    assert [status(later)[i] for i in ids] == ["active", "active", "analyzed", "active"]
    waiting = lambda moment: {r.id for r in triage.unfinished(found, verdicts, leases, moment).collect()}
    assert waiting(now) == {ids[1], ids[3]} and waiting(later) == {ids[0], ids[1], ids[3]}


def test_embedding(spark):
    df = spark.createDataFrame([(1, "A a b"), (2, "  "), (3, None)], "id long, text string")
    got = {r.id: r.embedding for r in memory.embed_text(df, ["id"], "text").collect()}
    assert abs(np.linalg.norm(got[1]) - 1) < 1e-6 and sorted(x for x in got[1] if x)[-1] > 0.89
    assert not any(got[2]) and not any(got[3]) and len(got[2]) == 128


def test_clustering(spark):
    texts = ["user alice logged in", "user bob logged in", "disk full on node", "user carol logged out now", "a b", "a c", "x y z"]
    rows = [("app", "prod", t, START + timedelta(seconds=i)) for i, t in enumerate(texts)]
    signatures = spark.createDataFrame(rows, "application string, environment string, template_text string, first_seen timestamp")
    whole = {r.template_text: r.mined_text for r in clustering.cluster_signatures(signatures).collect()}
    assert whole["user alice logged in"] == whole["user bob logged in"] == "user <*> logged in"
    assert whole["disk full on node"] == "disk full on node" and whole["a b"] == whole["a c"] == "a <*>"
    many = [("app", "prod", f"job w{i} ended well", START + timedelta(seconds=i)) for i in range(60)]
    many += [("app", "prod", f"step {i % 9}x of w{i}", START + timedelta(seconds=i)) for i in range(90)]
    df = spark.createDataFrame(many, signatures.schema)
    found = [sorted(map(tuple, clustering.cluster_signatures(df.repartition(n)).collect())) for n in (1, 7)]
    assert found[0] == found[1] and len(found[0]) == 150 and {r[3] for r in found[0]} == {"job <*> ended well", "step <*> of <*>"}


def test_known_templates_keep_their_ids(spark):
    schema = "application string, environment string, template_text string, first_seen timestamp"
    day = lambda texts: spark.createDataFrame([("app", "prod", t, START + timedelta(seconds=i)) for i, t in enumerate(texts)], schema)
    known = spark.createDataFrame(
        [("k1", "app", "prod", "user alice logged in", START), ("k2", "app", "prod", "disk full on node", START), ("k3", "app", "test", "user bob logged in", START)],
        "id string, application string, environment string, template_pattern string, first_seen timestamp",
    )
    rows = clustering.cluster_signatures(day(["user bob logged in", "disk full on node", "net down"]), known=known).collect()
    assert {r.template_text: (r.mined_text, r.template_id) for r in rows} == {
        "user bob logged in": ("user <*> logged in", "k1"), "disk full on node": ("disk full on node", "k2"), "net down": ("net down", None),
    }
    mined = spark.createDataFrame([(r.template_id, r.mined_text) for r in rows], "template_id string, template_text string")
    assert [tuple(r) for r in clustering.widened_templates(mined, known).collect()] == [("k1", "user alice logged in", "user <*> logged in")]


def test_versions_of_templates(spark):
    at = lambda hour: START + timedelta(hours=hour)
    catalog = lambda *rows: spark.createDataFrame(rows, "id string, application string, environment string, template_pattern string, first_seen timestamp")
    rules, others = versions.rules_version(depth=4, similarity=0.5), versions.rules_version(similarity=0.5, depth=5)
    assert rules != others and rules == versions.rules_version(similarity=0.5, depth=4)
    table = versions.new_versions(catalog(("a", "x", "p", "user alice in", at(0)), ("b", "x", "p", "down", at(1))), rules=rules)
    again = catalog(("a", "x", "p", "user <*> in", at(5)), ("b", "x", "p", "down", at(6)), ("c", "x", "p", "up", at(7)))
    added = versions.new_versions(again, table, rules)
    assert added.schema.simpleString() == TEMPLATE_VERSIONS.simpleString()
    assert {(r.template_id, r.version, r.valid_from) for r in added.collect()} == {("a", 2, at(5)), ("c", 1, at(7))}
    table = table.unionByName(added)
    assert versions.new_versions(again, table, rules).count() == 0
    assert {(r.template_id, r.version) for r in versions.new_versions(again, table, others).collect()} == {("a", 3), ("b", 2), ("c", 2)}

    schema = "template_id string, event_ts timestamp, source_path string, line_number long"
    rows = [("a", at(-1), "f", 1), ("a", at(4), "f", 2), ("a", at(5), "f", 3), ("a", at(5), "f", 3), ("b", at(9), "f", 4), ("z", at(9), "f", 5)]
    got = versions.with_pattern_at(spark.createDataFrame(rows, schema), table).collect()
    assert sorted((r.line_number, r.version, r.pattern) for r in got if r.version) == [
        (1, 1, "user alice in"), (2, 1, "user alice in"), (3, 2, "user <*> in"), (3, 2, "user <*> in"), (4, 1, "down"),
    ]
    assert [(r.line_number, r.pattern) for r in got if not r.version] == [(5, None)]
    assert versions.with_pattern_at(spark.createDataFrame(rows, schema), table.limit(0)).count() == 6


def test_merge_is_additive_and_keeps_the_founder(spark):
    df = observations(spark, [("a", 1, "ERROR", "/f", 1), ("a", 2, "INFO", "/f", 2), ("b", 3, "INFO", "/f", 3)])
    first, second = df.where("line_number = 1"), df.where("line_number > 1")
    merged = merges.merge_buckets(bk.rollup(first), bk.rollup(second)).collect()
    assert {(r.template_id, r["count"], r.error_count) for r in merged} == {("a", 2, 1), ("b", 1, 0)}
    from lanternlog.operators.templates import template_catalog

    catalog = {r.id: r for r in merges.merge_templates(template_catalog(first), template_catalog(second)).collect()}
    assert catalog["a"].total_count == 2 and catalog["a"].sample_message == "message 0"


def test_overwrite_of_the_table_that_is_read(spark):
    path = new_path(spark, "table")
    spark.range(10).select((F.col("id") % 2).alias("day"), "id").write.partitionBy("day").parquet(path)
    table = spark.read.parquet(path)
    merges.overwrite_partitions(table.where("day = 1").withColumn("id", F.col("id") + 100).select("id", "day"), path, ["day"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 2, 4, 6, 8, 101, 103, 105, 107, 109]


def test_feedback_and_retention(spark):
    df = observations(spark, [("a", 1, "INFO", "/f", 1), ("b", 86_400 * 190, "INFO", "/f", 2)])
    found = dt.detect_new_templates(df)
    feedback = found.where("template_id = 'a'").select(F.lit("f").alias("id"), F.col("id").alias("anomaly_id"), F.lit("False_Positive").alias("action"))
    assert {r.template_id: r.status for r in merges.apply_feedback(found, feedback).collect()} == {"a": "dismissed", "b": "active"}
    now = START + timedelta(days=190, hours=1)
    kept = retention.retain({"anomalies": found}, now)["anomalies"].collect()
    assert [(r.template_id, len(r.sample_evidence)) for r in kept] == [("b", 1)]
    assert retention.retention_report({"anomalies": found}, now).first().anomalies_deleted == 1
    later = retention.retain({"anomalies": found}, now + timedelta(days=2))["anomalies"].collect()
    assert [len(r.sample_evidence) for r in later] == [0]


def test_expired_days_are_deleted(spark):
    path = new_path(spark, "days")
    days = F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int"))
    spark.range(10).withColumn("day", days).write.partitionBy("day").parquet(path)
    now = datetime(2024, 1, 9, 12)
    assert retention.drop_expired_days(spark, path, now, hours=72) == [f"2024-01-0{n}" for n in range(1, 6)]
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [5, 6, 7, 8, 9]
    assert retention.drop_expired_days(spark, path, now, hours=72) == []
    assert retention.drop_expired_days(spark, path + "-none", now) == []

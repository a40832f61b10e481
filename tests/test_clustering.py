"""Templates by clustering: the index inside a piece, leaves cut into pieces, and pairs of templates."""

from __future__ import annotations

import random
import time
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from lanternlog import session
from lanternlog.operators import clustering, correlation

START = datetime(2024, 1, 1)
SIGNATURES = "application string, environment string, template_text string, first_seen timestamp"


def plain(patterns, known, similarity):
    """The quadratic way: every pattern against every cluster so far."""
    clusters, ids, member = [], [], []
    for pattern, name in zip(patterns, known):
        words = pattern.split()
        best, chosen = None, -1
        for i, held in enumerate(clusters):
            equal = sum(a == b != "<*>" for a, b in zip(words, held))
            score = (equal, sum(w == "<*>" for w in held))
            if best is None or score > best:
                best, chosen = score, i
        if name is not None or best is None or not (best[0] / len(words) >= similarity or clusters[chosen] == words):
            clusters.append(words), ids.append(name), member.append(len(clusters) - 1)
        else:
            clusters[chosen] = [a if a == b else "<*>" for a, b in zip(clusters[chosen], words)]
            member.append(chosen)
    return [" ".join(clusters[i]) for i in member], [ids[i] for i in member]


@pytest.mark.parametrize("similarity", [0.3, 0.5, 0.8])
def test_index_equals_the_quadratic_way(similarity):
    rng = random.Random(similarity)
    for _ in range(150):
        width, vocabulary = rng.randint(1, 7), rng.choice([2, 3, 6])
        patterns = sorted({
            " ".join(rng.choice(["<*>", *(f"w{i}" for i in range(vocabulary))]) for _ in range(width)) for _ in range(rng.randint(1, 60))
        }, key=lambda p: rng.random())
        cut = rng.randint(0, len(patterns) // 4)
        known = [f"k{i}" if i < cut else None for i in range(len(patterns))]
        found = clustering._cluster_piece(pd.DataFrame({"pattern": patterns, "known": pd.Series(known, dtype=object)}), similarity)
        merged, ids = plain(patterns, known, similarity)
        assert found["merged"].tolist() == merged and [x if isinstance(x, str) else None for x in found["template_id"]] == ids


def leaf_signatures(spark, n=260, seed=4):
    """One leaf of many signatures: some of few templates, some of rare words, in mixed order."""
    rng = random.Random(seed)
    rows = set()
    for i in range(n):
        kind = rng.randrange(4)
        if kind == 0:
            rows.add(f"job a{rng.randrange(9)} took w{i} of b{rng.randrange(3)} done")
        elif kind == 1:
            rows.add(f"job queue q{rng.randrange(4)} holds x{i} items")
        else:
            rows.add("job " + " ".join(f"{rng.choice('uvxyz')}{rng.randrange(12)}" for _ in range(5)))
    rows = sorted(rows, key=lambda r: rng.random())
    data = [("app", "prod", r, START + timedelta(seconds=i // 3)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, SIGNATURES)


def words(text):
    return [w for w in text.split(" ") if w]


def fits(text, template):
    return len(words(text)) == len(words(template)) and all(b in ("<*>", a) for a, b in zip(words(text), words(template)))


def test_cut_leaves_keep_nothing_similar_apart(spark, monkeypatch):
    monkeypatch.setattr(clustering, "PIECE", 8)
    df = leaf_signatures(spark)
    found = [sorted(map(tuple, clustering.cluster_signatures(df.repartition(n)).collect())) for n in (1, 6)]
    assert found[0] == found[1] and len(found[0]) == df.count()
    assert all(fits(text, template) for _, _, text, template, _ in found[0])
    by_width = defaultdict(set)
    for _, _, _, template, _ in found[0]:
        by_width[len(words(template))].add(template)
    for width, templates in by_width.items():
        matrix = np.array([words(t) for t in sorted(templates)])
        for i, row in enumerate(matrix):
            equal = ((matrix[:i] == row) & (row != "<*>")).sum(axis=1)
            assert not (equal >= width / 2).any()
    sizes = Counter(t for *_, t, _ in found[0])
    assert max(sizes.values()) > 30  # the templates that span pieces are merged


def test_cut_leaves_keep_known_ids(spark, monkeypatch):
    monkeypatch.setattr(clustering, "PIECE", 8)
    known = spark.createDataFrame(
        [("k1", "app", "prod", "job a1 took <*> of b1 done", START), ("k2", "app", "prod", "job queue q1 holds <*> items", START)],
        "id string, application string, environment string, template_pattern string, first_seen timestamp",
    )
    rows = clustering.cluster_signatures(leaf_signatures(spark), known=known).collect()
    assert all(fits(r.template_text, r.mined_text) for r in rows)
    ids = defaultdict(set)
    for r in rows:
        ids[" ".join(words(r.template_text)[1:2])].add(r.template_id)
    assert ids["queue"] == {"k2"} and any("k1" in ids[f"a{i}"] for i in range(9))


def test_empty_signatures(spark):
    assert clustering.cluster_signatures(spark.createDataFrame([], SIGNATURES)).collect() == []


EVENTS = "application string, environment string, source_path string, line_number long, event_ts timestamp, sanitized_message string"


def log_events(spark, n, seed=7):
    """Lines of many texts, some of few templates and often repeated, some long and of their own."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = f"job a{rng.randrange(4)} took w{rng.randrange(30)} of b done"
        if i % 3:
            text = " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(rng.randint(3, 30)))
        rows.append((f"app-{i % 2}", "prod", "/f", i, START + timedelta(seconds=i), text))
    return spark.createDataFrame(rows, EVENTS).repartition(3)


def size_of(path):
    return sum(p.stat().st_size for p in Path(str(path).removeprefix("file:")).rglob("*") if p.is_file())


def test_mined_rows_alone_stay_on_disk(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(clustering, "ROUND_BYTES", 200_000, raising=False)
    session.ship_package(spark)
    events = log_events(spark, 6_000)
    before = size_of(session.shared_dir(spark))
    mined = clustering.mine_templates(events)
    held = size_of(session.shared_dir(spark)) - before
    mined.write.parquet(str(tmp_path / "mined"), compression="zstd")
    assert mined.count() == 6_000 and held < 1.5 * size_of(tmp_path / "mined")


def test_rounds_hold_a_share_of_the_texts(spark, monkeypatch):
    monkeypatch.setattr(clustering, "PARTS", 6)
    events = log_events(spark, 6_000)
    before = size_of(session.shared_dir(spark))
    peaks = []
    for size in (1 << 30, 1):
        monkeypatch.setattr(clustering, "ROUND_BYTES", size)
        seen = []
        write = session.write_compact

        def watched(df, path, *rest, write=write, seen=seen, **options):
            write(df, path, *rest, **options)
            seen.append(size_of(session.shared_dir(spark)))

        monkeypatch.setattr(session, "write_compact", watched), monkeypatch.setattr(clustering, "write_compact", watched)
        clustering.mine_templates(events, keep=[])
        monkeypatch.setattr(session, "write_compact", write), monkeypatch.setattr(clustering, "write_compact", write)
        peaks.append(max(seen) - before)
        before = size_of(session.shared_dir(spark))
    assert peaks[1] < 0.7 * peaks[0]


def test_rounds_give_the_same_templates(spark, monkeypatch):
    monkeypatch.setattr(clustering, "PIECE", 60)
    monkeypatch.setattr(clustering, "PARTS", 3)
    odd = [("app-0", "prod", "/g", 1, START, t) for t in ("", "  two  blanks  here ", "x1 of y", "twice", "twice", None)]
    odd += [(None, "prod", "/g", 2, START, "no scope"), ("app-0", None, "/g", 3, None, "no scope")]
    events = log_events(spark, 400).unionByName(spark.createDataFrame(odd, EVENTS))
    known = spark.createDataFrame(
        [("k1", "app-0", "prod", "job a1 took <*> of b done", START), ("k2", "app-1", "prod", "never seen", START)],
        "id string, application string, environment string, template_pattern string, first_seen timestamp",
    )
    found = []
    for size in (1 << 30, 1):
        monkeypatch.setattr(clustering, "ROUND_BYTES", size)
        found.append(sorted(map(tuple, clustering.mine_templates(events, known=known).collect()), key=repr))
    assert found[0] == found[1] and len(found[0]) == 405
    assert {r[-1] for r in found[0] if r[0] == "app-0" and r[-2].startswith("job")} == {"k1"}
    kept = clustering.mine_templates(events, known=known, keep=["line_number"])
    assert kept.columns == ["application", "environment", "line_number", "template_text", "template_id"]
    assert clustering.mine_templates(events.limit(0), keep=[]).collect() == []


def test_rounds_are_cut_by_size(monkeypatch):
    monkeypatch.setattr(clustering, "ROUND_BYTES", 10)
    assert clustering._rounds({}) == [[]]
    assert clustering._rounds({"a": 4, "b": 6, "c": 1, "d": 30, "e": 2}) == [["a", "b"], ["c"], ["d"], ["e"]]


def test_shuffle_files_of_a_write_go(spark, tmp_path):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        found = files.getAllFiles()
        return {f for f in (found.apply(i).getName() for i in range(found.size())) if f.startswith("shuffle_")}

    before = shuffled()
    session.write_compact(spark.range(20_000).repartition(3, "id"), str(tmp_path / "out"))
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before and spark.read.parquet(str(tmp_path / "out")).count() == 20_000


def observations(spark, rows):
    data = [("app", "prod", t, s, START + timedelta(minutes=5 * b)) for b, t, s in rows]
    return spark.createDataFrame(data, "application string, environment string, template_id string, source_id string, event_ts timestamp")


def random_rows(seed, templates=30, buckets=60):
    rng = random.Random(seed)
    rows = []
    for b in range(buckets):
        for t in rng.sample(range(templates), rng.randint(1, 6)):
            rows += [(b, f"t{t:02}", f"s{t % 3}")] * rng.randint(1, 2)
        if b % 9 == 0:
            rows += [(b, f"burst{i}", f"s{i % 2}") for i in range(4)] + [(b, "t00", "s1")]
    return rows


def brute_pairs(rows, k, lift):
    """All pairs of all templates, class by class, straight from the definition."""
    sources = defaultdict(set)
    for b, t, s in rows:
        sources[b, t].add(s)
    total = len({b for b, _ in sources})
    where = defaultdict(dict)
    for (b, t), s in sources.items():
        where[t][b] = (min(s), max(s))
    good = {t: w for t, w in where.items() if len(w) >= k and len(w) * lift <= total}
    classes = defaultdict(list)
    for t in sorted(good):
        classes[tuple(sorted(good[t].items()))].append(t)
    out = {}
    names = [(m[0], dict(w), len(m)) for w, m in classes.items()]
    for a, wa, ma in names:
        for b, wb, mb in names:
            if a < b or (a == b and ma > 1):
                together = sum(1 for x in wa.keys() & wb.keys() if not (wa[x] == wb[x] and wa[x][0] == wa[x][1]))
                if together >= k and together * total / (len(wa) * len(wb)) >= lift:
                    out[a, b] = (together, ma, mb)
    return out


@pytest.mark.parametrize("k, lift", [(1, 1.5), (2, 2.0), (3, 3.0)])
def test_pairs_against_all_pairs(spark, k, lift):
    for seed in (1, 2):
        rows = random_rows(seed)
        found = correlation.unusual_template_pairs(observations(spark, rows), 5, k, lift).collect()
        got = {(r.left_id, r.right_id): (r.together, r.left_templates, r.right_templates) for r in found}
        expected = brute_pairs(rows, k, lift)
        assert got == expected and len(found) == len(got)
        assert expected or k == 3


def test_candidates_grow_with_the_input_and_bursts_stay_one_row(spark):
    def candidates(copies):
        rows = [(b + 60 * c, f"{t}-{c}", s) for c in range(copies) for b, t, s in random_rows(c)]
        seen = correlation._seen_buckets(observations(spark, rows), 5)
        classes = correlation._classes(seen, 2, 2.0)
        sizes = classes.select("application", "environment", "class_id", "buckets", "total").distinct()
        placed = seen.withColumnRenamed("template_id", "class_id").join(sizes, ["application", "environment", "class_id"])
        return correlation.pair_candidates(placed, 2, 2.0).count()

    one, four = candidates(1), candidates(4)
    assert one and four <= 6 * one
    burst = [(b, f"x{i:03}", f"s{i % 2}") for b in (3, 40, 55) for i in range(200)] + [(b, "calm", "s0") for b in range(60)]
    classes = correlation.template_classes(observations(spark, burst), 5, 3, 3.0).collect()
    assert len(classes) == 200 and {r.class_id for r in classes} == {"x000", "x001"}
    pairs = correlation.unusual_template_pairs(observations(spark, burst), 5, 3, 3.0).collect()
    assert [(r.left_id, r.right_id, r.left_templates, r.right_templates, r.together) for r in pairs] == [("x000", "x001", 100, 100, 3)]

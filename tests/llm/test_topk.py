"""Exact top-k search against all products."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternlog.llm import queries, topk

SF = "/root/testdata/sf0.001"


def brute(rows, k, asks):
    """rows: (id, vector); exact in whole numbers of any size."""
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (key, q) in enumerate(good):
        if key is None or not asks(key):
            continue
        scored = [(-sum(x * y for x, y in zip(q, c, strict=True)), i is None, i or 0, i) for b, (i, c) in enumerate(good) if a != b and len(c) == len(q)]
        out += [(key, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=repr)


def frame(spark, rows, kind="float"):
    data = [(i, None if v is None else [None if x is None else float(x) for x in v], "x", "y") for i, v in rows]
    return spark.createDataFrame(data, f"vec_id bigint, embedding array<{kind}>, score string, rank string")


def found(df, k=20, every=20):
    best = topk.best_products(topk.scaled(df, 64), F.col("vec_id") % every == 0, k)
    return sorted((tuple(r) for r in best.collect()), key=repr)


def cluster_rows(n, seed, width=32):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, width)) * np.geomspace(1, 0.02, width)
    vectors = np.float32(centres[rng.integers(0, 8, n)] + rng.normal(size=(n, width)) * 0.01)
    return [(i, v.tolist()) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("shard, held, block", [(16_384, 8192, 128), (40, 7, 3)])
def test_clusters_are_pruned_and_exact(spark, monkeypatch, shard, held, block):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "HELD", held)
    rows = cluster_rows(600, 3)
    assert found(frame(spark, rows)) == brute(rows, 20, lambda i: i % 20 == 0)


def test_compaction_gives_all_that_reach_the_bound(monkeypatch):
    monkeypatch.setattr(topk, "STEP", 4)
    rng = np.random.default_rng(1)
    seen = set()
    for trial in range(60):
        m, n, d, k = 5, int(rng.integers(1, 200)), int(rng.integers(1, 30)), 4
        spread = np.geomspace(1, rng.choice([1, 0.01]), d)
        asked, cells = np.floor(64 * rng.normal(size=(m, d)) * spread), np.floor(64 * rng.normal(size=(d, n)) * spread[:, None])
        whole = asked @ cells
        own = np.array([0, 3]), np.array([0, n - 1])
        whole[own] = -np.inf
        least = np.where(rng.random(m) < 0.2, -np.inf, np.sort(whole, axis=1)[:, max(0, n - 6)]) if trial % 3 else np.full(m, -np.inf)
        query, spot, score = topk._survivors(asked, cells, least, own, k)
        assert (whole[query, spot] == score).all()
        got = set(zip(query.tolist(), spot.tolist(), strict=True))
        for q in range(m):
            order = sorted((-whole[q, c], c) for c in range(n) if np.isfinite(whole[q, c]) and whole[q, c] >= least[q])
            assert {(q, c) for _, c in order[:k]} <= got
        seen.add(len(got) < m * n)
    assert True in seen


def test_ties_odd_vectors_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 50)
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-2, 3, 6).tolist()) for i in range(150)]
    rows += [(None, [1] * 6), (None, [1] * 6), (20, [1] * 6), (20, [1] * 6), (40, None), (60, [1, None, 0, 0, 0, 0]), (80, [math.nan] * 6)]
    rows += [(100, [math.inf] + [0] * 5), (700, []), (701, []), (720, [0] * 6), (800, [1.0, 2.0]), (801, [1.0, 2.5]), (820, [0.5] * 3)]
    rows += [(i, [3, 3, 3, 3, 3, 3]) for i in range(1000, 1120)]
    assert found(frame(spark, rows)) == brute(rows, 20, lambda i: i % 20 == 0)
    assert found(frame(spark, rows[:12])) == brute(rows[:12], 20, lambda i: i % 20 == 0)
    assert found(frame(spark, [])) == [] == found(frame(spark, [(20, [1.0])]))


def test_numbers_beyond_double_precision(spark):
    rows = [(i, [float(10**7 + i), float(-(10**7) + 3 * i), float(7 * i)]) for i in range(60)]
    assert found(frame(spark, rows, "double")) == brute(rows, 20, lambda i: i % 20 == 0)


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op13_topk(spark, SF).collect()), key=repr)
    assert got == brute(rows, 20, lambda i: i % 20 == 0) and got

"""Near-duplicates, fingerprints and embeddings, against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lanternlog.llm import common, hnsw, simhash, syncmers
from llm import odd


def reach(ids, links):
    """Smallest id reachable from each."""
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("links", [
    [], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(i, i + 7) for i in range(0, 90)], [(3, 3), (5, 4), (4, 5)],
])
def test_components(spark, links):
    ids = {x for pair in links for x in pair if pair[0] != pair[1]}
    found = common.components(spark.createDataFrame([*links, (None, 1)], "a bigint, b bigint"), "a", "b").collect()
    assert {r.node: r.component for r in found} == reach(ids, [p for p in links if p[0] != p[1]])


def test_kth_largest(spark):
    rng = random.Random(2)
    values = [rng.gauss(0, 1) for _ in range(500)] + [0.25] * 40
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 100, 270, 540):
        assert common.kth_largest(df, "x", k, few=10) == sorted(values, reverse=True)[k - 1]


def plain_simhash(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    out = []
    for n in range(12):
        base = [rng.choice(words) for _ in range(rng.choice((20, 150, 400)))]
        for _ in range(rng.choice((1, 2, 9))):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append((len(out) * 3 % 101 + 1000 * n, " ".join(copy)))
    return out


def test_simhash_near_duplicates(spark):
    rows = [(i, t) for i, t in odd.texts() + near_texts() if i is not None and i != 0]
    found = {r.doc_id: r for r in simhash.near_duplicates(odd.frame(spark, rows)).withColumn("hex", simhash.hex_fingerprint()).collect()}
    prints = {i: plain_simhash(t or "") for i, t in rows}
    assert {i: r.hex for i, r in found.items()} == {i: f"{x:016x}" for i, x in prints.items()}
    ids = sorted(prints)
    links = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {i: r.component_id for i, r in found.items()} == reach(ids, links)
    assert len(set(reach(ids, links).values())) < len(ids)


def test_simhash_odd_rows(spark):
    rows = simhash.near_duplicates(odd.frame(spark)).collect()
    assert len(rows) == len(odd.texts())
    zero = [r for r in rows if r.fp == 0]
    assert {r.component_id for r in zero} == {100}
    assert simhash.near_duplicates(odd.frame(spark, [])).count() == 0
    assert simhash.near_duplicates(odd.frame(spark, [(None, "a b c d")])).head().component_id is None


def test_postings_of_any_size_connect_the_same():
    """Dense balls of fingerprints, listed pair by pair and through their neighbours' values."""
    rng = np.random.default_rng(4)
    for spread in (3, 6, 10, 16):
        fps = np.unique(rng.integers(0, 1 << spread, 300, np.uint64) | np.uint64(0xABCDEF << 32))
        a, b = simhash._posting_links(fps)
        links = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 2]
        assert reach(range(len(fps)), list(zip(a.tolist(), b.tolist(), strict=True))) == reach(range(len(fps)), links)


def test_posting_stream_keeps_postings_whole():
    fps = np.array([0, 1, 3, 7, 1 << 20, 1 << 21], np.int64)
    rows = [np.zeros(6, np.int64), np.array([0, 0, 0, 0, 9, 9]), fps, np.arange(6)]
    whole = None
    for cut in range(1, 6):
        batches = [pa.RecordBatch.from_arrays([pa.array(r[s]) for r in rows], ["choice", "posting", "fp", "rep"]) for s in (slice(0, cut), slice(cut, 6))]
        links = sorted((x["a"], x["b"]) for out in simhash.posting_links(iter(batches)) for x in out.to_pylist())
        whole = whole or links
        assert links == whole and (0, 1) in links and (0, 3) not in links


def plain_anchors(text):
    """Closed syncmers by definition: k-mers whose smallest inner string (by its hash) is the first or the last."""
    if len(text) < syncmers.LENGTH:
        return []
    codes = [ord(c) for c in text]
    order = [int(syncmers._mixed(np.array([codes[i] << 42 | codes[i + 1] << 21 | codes[i + 2]], np.uint64))[0]) for i in range(len(codes) - 2)]
    out = []
    for i in range(len(text) - syncmers.LENGTH + 1):
        inner = order[i : i + syncmers.LENGTH - syncmers.INNER + 1]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


def test_syncmers_are_free_of_context():
    passage = "the quick brown fox jumps over the lazy dog and runs away from it"
    at, hashes = syncmers.anchors(passage)
    assert at.tolist() == plain_anchors(passage)
    shifted, again = syncmers.anchors("Some other beginning. " + passage + " An end.")
    assert {(p + 22, h) for p, h in zip(at.tolist(), hashes.tolist(), strict=True)} <= set(zip(shifted.tolist(), again.tolist(), strict=True))


def test_compare_edits(spark):
    rows = [(i, t) for i, t in odd.texts() + near_texts()]
    found = syncmers.compare_edits(odd.frame(spark, rows)).collect()
    ordered = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    ordered = [(i, t or "") for i, t in ordered]
    expected = []
    for n, (i, text) in enumerate(ordered):
        after = ordered[(n + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = (syncmers.sketch(syncmers.anchors(x)[1]) for x in (text, edited, after))
        expected.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), syncmers.as_text(a), syncmers.as_text(b),
                         syncmers.likeness(a, b), syncmers.likeness(a, c)))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)
    assert syncmers.compare_edits(odd.frame(spark, [])).count() == 0
    (one,) = syncmers.compare_edits(odd.frame(spark, [(7, "abcdefghij klmnop")])).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdefghiabcdefgh").hexdigest()


def test_fingerprints(spark):
    rows = syncmers.fingerprints(odd.frame(spark)).collect()
    by_text = {}
    texts = dict((i, t) for i, t in odd.texts() if i not in (None, 0))
    for r in rows:
        if r.doc_id in texts:
            t = texts[r.doc_id] or ""
            assert by_text.setdefault(t, r.fingerprint) == r.fingerprint and r.n_chars == len(t)
            assert (r.fingerprint == "") == (t == "") and len(r.positions) == len(r.hashes)


def vectors(seed=6, n=500, wide=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, wide))
    rows = []
    for i in range(n):
        v = centres[rng.integers(40)] + rng.normal(size=wide) * rng.choice((0.0, 0.1, 0.3))
        rows.append((i * 7 % n, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    return rows


def brute_links(rows, least=0.93):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows])
    norm = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / (norm[:, None] * norm[None, :]) >= least
    labels = np.array([r[2] for r in rows])
    near &= labels[:, None] == labels[None, :]
    np.fill_diagonal(near, False)
    return dict(zip(ids, near.sum(axis=1).tolist(), strict=True)), reach(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])


SCHEMA = "vec_id bigint, embedding array<float>, label int, n_links string, component_id string, kept string, rep string, shard string"


@pytest.mark.parametrize("shard", [4096, 40])
def test_link_near(spark, shard):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)
    found = hnsw.link_near(df, shard=shard).collect()
    counts, component = brute_links(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == {i: (counts[i], component[i], component[i] == i) for i in counts}


def test_link_near_odd_rows(spark):
    nan, one = float("nan"), [1.0, 0.0, 0.5]
    rows = [
        (1, one, 0), (2, one, 0), (3, one, 1), (4, one, None), (5, None, 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 0.5], 0),
        (8, [1.0, nan, 0.5], 0), (9, [1.0, float("inf"), 0.5], 0), (10, [], 0), (11, [1.0, 0.0], 0), (12, [2.0, 0.0, 1.0], 0), (None, one, 0),
    ]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.link_near(df).collect()}
    assert found == {1: (2, 1, True), 2: (2, 1, False), 12: (2, 1, False), None: (0, None, False)} | {i: (0, i, True) for i in range(3, 12)}
    assert hnsw.link_near(df.limit(0)).count() == 0


def test_graph_finds_nearly_all_links_and_widens_for_crowded_ones():
    rng = np.random.default_rng(8)
    crowd = rng.normal(size=32) + 0.02 * rng.normal(size=(700, 32))
    others = rng.normal(size=(1500, 32))
    pairs = others[:300] + 0.05 * rng.normal(size=(300, 32))
    x = rng.permutation(np.concatenate([crowd, others, pairs]))
    table = pa.table({"rep": np.arange(len(x)), "copies": np.ones(len(x), np.int64), "embedding": pa.array(list(x)), "shard": np.zeros(len(x), np.int32)})
    built = hnsw.build_shard(table)
    reps, links, roots, hits, true = hnsw.find_links(built, built.drop_columns(["neighbours"]), 0.93)
    counts, component = brute_links([(i, v, 0) for i, v in enumerate(x)])
    assert sum(links) >= 0.99 * sum(counts.values()) and hits >= 0.99 * true
    assert dict(zip(reps.tolist(), roots.tolist(), strict=True)) == {i: component[i] for i, n in counts.items() if n}

"""The Merkle manifest against a plain recursive one, with small blocks and odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lanternlog.llm import merkle, queries
from llm import odd


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, extra=0):
    values = (row[0], row[3], row[2], None if row[4] is None else row[4] + extra, row[1])
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Root, and for each leaf what stands beside its ancestors."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(place):
            other = at ^ 1
            left, right = (nodes[other], "") if at % 2 else ("", nodes[other] if other < len(nodes) else "")
            paths[i].append((left, right))
        nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        place = [at // 2 for at in place]
    return nodes[0], paths


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, roots = {}, []
    for group in order:
        members = sorted(groups[group], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[group] = members, *tree([leaf(r) for r in members])
        roots.append(trees[group][1])
    root, above = tree(roots)
    out = []
    for at, group in enumerate(order):
        members, subroot, paths = trees[group]
        for row, path in zip(members, paths, strict=True):
            path = path + above[at]
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            h = leaf(row, int(tampered))
            for left, right in path:
                h = digest(left, h, right)
            out.append((row[0], leaf(row), subroot, root, digest(*(a + b for a, b in path)), h, h == root))
    return sorted(out, key=repr)


def found(spark, rows, folder):
    frame = odd.frame(spark, [(r[0], r[1]) for r in rows]).drop("lang", "source", "n_chars")
    data = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in frame.columns[2:]:
        data = data.withColumn(name, F.lit("x"))
    data.repartition(7).write.parquet(f"{folder}/documents.parquet")
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[n] for n in names) for r in queries.op12_merkle(spark, str(folder)).collect()), key=repr)


def some_rows(n, langs, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(langs)
        rows.append((i, f"text {rng.random()} é🙂", lang, rng.choice([None, "web"]), rng.choice([None, i])))
    return rows


@pytest.mark.parametrize("height, n", [(2, 50), (10, 90)])
def test_small_blocks_and_tiers(spark, monkeypatch, tmp_path, height, n):
    """Blocks of four nodes: several tiers, and a tree over the groups that has more than one block."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rows = some_rows(n, ["en"] * 20 + [None, "de", "fr", "z", "é", "ZZ", "a"])
    result = found(spark, rows, tmp_path)
    assert result == brute(rows)
    assert not all(r[6] for r in result) and any(r[6] for r in result)


def test_odd_rows(spark, tmp_path):
    texts = odd.texts()
    rows = [(i, t, [None, "en", "fr"][n % 3], None, n) for n, (i, t) in enumerate(texts)]
    rows += [(5, "same", "en", "web", 4)] * 5 + [(5, "other", "en", "web", 4), (None, None, None, None, None)]
    assert found(spark, rows, tmp_path) == brute(rows)


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(spark, tmp_path, n):
    rows = some_rows(n, ["en"])
    assert found(spark, rows, tmp_path) == brute(rows) if n else found(spark, rows, tmp_path) == []


def test_hot_group_of_equal_rows_in_small_blocks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(merkle, "HEIGHT", 3)
    rows = [(1, "copy", "en", None, 1)] * 60 + some_rows(20, ["en"])
    assert found(spark, rows, tmp_path) == brute(rows)


def test_other_columns(spark):
    df = spark.createDataFrame([("g", 2, "b"), ("g", 1, "a"), ("h", 1, "c")], "kind string, at int, body string")
    rows = {r.at: r for r in merkle.manifest(df, F.sha2("body", 256), "kind", "at").where("kind = 'g'").collect()}
    assert rows[1].subroot == digest(digest("a"), digest("b")) and rows[1].root == digest(rows[1].subroot, digest("c"))
    assert rows[2].path == [digest("a"), "", "", digest("c")]

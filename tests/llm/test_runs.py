"""Periodic runs against the definition, on random words, odd rows and the registered query."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lanternlog.llm import queries, word_runs
from llm import odd

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(words, least_words=24, least_periods=3):
    """Every stretch that keeps a period, for every period; then those whose smallest period it is."""
    n, out = len(words), []
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least_words, least_periods * q):
                stretch = words[i : j + q]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(key, text):
    words = words_of(text)
    n = len(words)
    h = 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    found = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return key, len(runs), *found, digest(listed), digest(kept)


@pytest.mark.parametrize("least", [(24, 3), (1, 3), (5, 4)])
def test_runs_of_random_words(least):
    rng = random.Random(least[0])
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 4)):
            n = rng.randint(0, 120)
            words = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(n)]
            if n and rng.random() < 0.6:
                p, s = rng.randint(1, 12), rng.randrange(n)
                for i in range(s + p, min(n, s + p * rng.randint(2, 9))):
                    words[i] = words[i - p]
            docs.append(words)
        begins = np.cumsum([0] + [len(d) for d in docs])
        found = list(zip(*(x.tolist() for x in word_runs.find_runs(np.array(sum(docs, []), np.int64), begins, *least)), strict=True))
        assert found == [(s + int(b), length, q) for d, b in zip(docs, begins, strict=False) for s, length, q in brute_runs(d, *least)]


def test_fibonacci_words_and_one_word():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    for words in (b, [7] * 100, [1, 2] * 60 + [1]):
        found = word_runs.find_runs(np.array(words), np.array([0, len(words)]), 6, 3)
        assert list(zip(*(x.tolist() for x in found), strict=True)) == brute_runs(words, 6, 3)


def rows_of(df):
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_odd_rows(spark, tmp_path):
    extra = [(300, "go " * 30), (301, "a b c " * 40 + "x " + "a b c " * 9), (302, "s " * 23), (303, " ".join("pq" * 40)), (10, "x y " * 400)]
    rows = odd.texts() + extra
    odd.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(queries.op11_word_runs(spark, str(tmp_path))) == sorted((brute_row(*r) for r in rows), key=repr)
    assert word_runs.periodic_runs(odd.frame(spark, [])).collect() == []


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(words_of(r.text)) < 1500]
    keep = spark.createDataFrame([(i,) for i, _ in docs], "doc_id bigint")
    found = queries.op11_word_runs(spark, SF).join(keep, "doc_id", "left_semi")
    assert rows_of(found) == sorted((brute_row(*r) for r in docs), key=repr)
    assert sum(r[1] > 0 for r in rows_of(found)) > 10


def test_collapsed_text(spark):
    df = spark.createDataFrame([("k", "start " + "ha ho " * 20 + "end")], "name string, body string")
    row = word_runs.periodic_runs(df, "name", "body").first()
    assert row.collapsed == "start ha ho end" and row.n_words == 42 and [tuple(r) for r in row.runs] == [(1, 40, 2)]

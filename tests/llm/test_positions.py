"""Fingerprints of whole texts: anchors matched by their positions."""

from __future__ import annotations

import random

import numpy as np

from lanternlog.llm import syncmers


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_a_passage_changes_the_fingerprint_of_a_long_text():
    rng = random.Random(4)
    for _ in range(20):
        text, passage = prose(rng, 3000), prose(rng, 60)
        cut = rng.randrange(len(text))
        old, new = (syncmers.sketch(syncmers.anchors(t)[1]) for t in (text, text[:cut] + " " + passage + " " + text[cut:]))
        inner = set(syncmers.sketch(syncmers.anchors(passage)[1]).tolist())
        assert inner <= set(new.tolist()) and syncmers.as_text(old) != syncmers.as_text(new)
        assert len(old) == len(syncmers.anchors(text)[0])
        assert len(old) - 20 <= syncmers.matched(old, new) <= len(old)
        assert abs(syncmers.likeness(old, new) - len(old) / len(new)) < 0.01


def test_order_counts():
    rng = random.Random(5)
    one, two = prose(rng, 300), prose(rng, 300)
    a, b = (syncmers.sketch(syncmers.anchors(t)[1]) for t in (one + " " + two, two + " " + one))
    assert 0.25 < syncmers.likeness(a, b) < 0.45 and syncmers.likeness(a, a) == 1.0


def test_matches_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (rng.permutation(40)[: rng.integers(1, 30)].astype(np.uint32) for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        assert syncmers.matched(a, b) == best[-1, -1]

"""Exact token counts at every prefix of a word, and what follows from them: counts, limits, cut points.

For each position of a word there is exactly one token that ends the encoding of the prefix up to there: the one whose own
start has an ending token that it can stand next to. The count at the position is the count at that start plus one. The table
of all prefixes therefore answers how many tokens any cut leaves, without encoding again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lanternlog.llm.bpe import PLAIN, Merges, byte_letters
from lanternlog.llm.common import map_batches, offsets_of, ragged, slices
from lanternlog.llm.known import Growing, Known, Runs, cut_at_spaces, text_bytes

#: Fixed value: how byte-level vocabularies of this kind cut text into words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def prefix_counts(merges: Merges, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of every prefix of every word (a number per byte), and where each word begins."""
    flat, bounds = merges.symbols(words)
    sizes = np.diff(bounds)
    stop, first = np.repeat(bounds[1:], sizes), np.repeat(bounds[:-1], sizes)
    live, node = np.arange(len(flat)), np.zeros(len(flat), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    k = 0
    while len(live):
        node = merges.step[(node << 9 | flat[live + k]).astype(np.uint64)].astype(np.int64)
        live, node = live[node >= 0], node[node >= 0]
        token = merges.token_at[node]
        hit = token >= 0
        found.append((live[hit], live[hit] + k, token[hit]))
        k += 1
        inside = live + k < stop[live]
        live, node = live[inside], node[inside]
    counts = np.zeros(len(flat), np.int32)
    if not found:
        return counts, bounds
    begin, end, token = (np.concatenate([f[i] for f in found]) for i in range(3))
    place = end - first[end]
    order = np.argsort(place, kind="stable")
    begin, end, token = begin[order], end[order], token[order].astype(np.int64)
    cuts = np.r_[np.searchsorted(place[order], np.arange(int(place.max()) + 2))]
    last = np.full(len(flat), -1, np.int64)
    for a, b in zip(cuts, cuts[1:], strict=False):
        s, e, t = begin[a:b], end[a:b], token[a:b]
        inner = s > first[s]
        before = last[s - 1]
        good = ~inner
        test = np.flatnonzero(inner & (before >= 0))
        good[test] = merges.holds_all(before[test], t[test])
        s, e, t, inner = s[good], e[good], t[good], inner[good]
        last[e] = t
        counts[e] = np.where(inner, counts[s - 1], 0) + 1
    return counts, bounds


class Counter(Known):
    """Counts of texts through a table of known stretches; each has the counts of all its prefixes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.merges, self.library = Merges(path), Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.letters = byte_letters()
        self.forget()

    def forget(self) -> None:
        super().forget()
        self.prefixes, self.totals = Runs(np.int32), Growing(np.int64)

    def _words(self, text: str) -> list[bytes]:
        if PLAIN.fullmatch(text):
            return [w.encode() for w in WORDS.findall(text)]
        return [bytes(self.letters[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _parts(self, text: str) -> list[tuple[list[bytes], bool]]:
        """Words of the stretches between special tokens, and the special tokens themselves."""
        if not any(s in text for s in self.special):
            return [(self._words(text), False)]
        return [([x.encode()], True) if x in self.special else (self._words(x), False) for x in self.cut.split(text) if x]

    def learn(self, parts: list[bytes]) -> None:
        words: dict[tuple[bytes, bool], int] = {}
        rows = [
            [words.setdefault((w, special), len(words)) for some, special in self._parts(p.decode()) for w in some] for p in parts
        ]
        counts, bounds = prefix_counts(self.merges, [w for w, _ in words])
        for (_, special), i in words.items():
            if special:  # counts once it is complete
                counts[bounds[i] : bounds[i + 1]] = 0
                counts[bounds[i + 1] - 1] = 1
        n = np.fromiter(map(len, rows), np.int64, len(rows))
        at = np.fromiter((w for row in rows for w in row), np.int64, int(n.sum()))
        sizes, word_ends = np.diff(bounds)[at], offsets_of(n)
        running = offsets_of(counts[bounds[1:][at] - 1].astype(np.int64))
        before = running[:-1] - np.repeat(running[word_ends[:-1]], n)
        flat = counts[ragged(bounds[:-1][at], sizes)] + np.repeat(before, sizes)
        self.prefixes.extend(flat, np.diff(offsets_of(sizes)[word_ends]))
        self.totals.extend(np.diff(running[word_ends]))

    def stretches(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the stretches of all texts, and where each text's begin."""
        data, bounds = text_bytes(column)
        starts, ends, counts = cut_at_spaces(data, bounds, [t.encode() for t in self.special])
        return self.number(data, starts, ends), offsets_of(counts)

    def prefix_table(self, text: str) -> np.ndarray:
        """Tokens that the encoding of each prefix has, cut after each byte: a number per byte."""
        at, _ = self.stretches(pa.array([text], pa.string()))
        return self.prefixes.take(at) + np.repeat(offsets_of(self.totals.all[at])[:-1], self.prefixes.lengths(at))

    def fitting_bytes(self, at: np.ndarray, limit: int) -> int:
        """Bytes of the longest prefix whose table entries all stay within ``limit`` tokens."""
        running, sizes = offsets_of(self.totals.all[at]), self.prefixes.lengths(at)
        k = int(np.searchsorted(running, limit, side="right")) - 1
        out = int(sizes[:k].sum())
        if k < len(at):
            own = self.prefixes.take(at[k : k + 1])
            over = np.flatnonzero(own > limit - running[k])
            out += int(over[0]) if len(over) else len(own)
        return out


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, fit_bytes) of every whole text, one row per input row.

    ``fit_bytes``: bytes from the start whose prefix table stays within ``limit`` tokens; all of a text that is not over the
    limit. Null and empty texts have no bytes and no tokens. Ids may be null or repeated; further columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(path)
        for batch in slices(batches):
            at, rows = table.stretches(batch.column(1))
            n = np.diff(offsets_of(table.totals.all[at])[rows])
            size = np.diff(offsets_of(table.prefixes.lengths(at))[rows])
            fit = size.copy()
            for i in np.flatnonzero(n > limit):
                fit[i] = table.fitting_bytes(at[rows[i] : rows[i + 1]], limit)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit), pa.array(fit)],
                [id_col, "n_bytes", "n_tokens", "over_limit", "fit_bytes"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_bytes bigint"
    return map_batches(df.select(id_col, text_col), work, schema)

"""Byte-pair encoding by speculation: greedy longest matches are proposed and kept where every adjacent pair holds.

A sequence of tokens is what merging by rank gives exactly if each token alone is, and if no merge crosses any border between
two neighbours. Whether a merge crosses a border depends on the two neighbours alone, so all borders of a batch of words are
tested at once; only words with a failing border are merged step by step.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lanternlog.llm.common import map_batches, offsets_of, ragged, slices
from lanternlog.llm.known import Growing, Known, Runs, Table, cut_at_white, text_bytes

NEVER = np.int32(2**31 - 1)
WIDTH = 17  # bits of a token id
#: Characters on which the libraries' tables of letters, numbers and white space surely agree; other texts take the library's way.
PLAIN = regex.compile("[\t\n\r\x20-\x7e¡-ɏ]*")


@lru_cache(1)
def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files, by letter."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Merge table of a vocabulary file; words are arrays of symbols: a byte, plus 256 where a word ends (if endings are marked)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.ending = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        size = max(vocab.values()) + 1
        letters = byte_letters()
        self.base = np.full(512, -1, np.int32)
        for letter, byte in letters.items():
            self.base[byte] = vocab.get(letter, -1)
            if self.ending:
                self.base[256 + byte] = vocab.get(letter + self.ending, -1)
        symbols: dict[int, tuple[int, ...]] = {int(t): (s,) for s, t in enumerate(self.base) if t >= 0}
        self.birth = np.full(size, -1, np.int32)
        self.left, self.right = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        ranks: dict[tuple[int, int], tuple[int, int]] = {}
        twice = set()
        for rank, pair in enumerate(model["merges"]):
            one, two = pair.split(" ") if isinstance(pair, str) else pair
            a, b = vocab[one], vocab[two]
            joined = one + two
            token = vocab[joined]
            if token in symbols:
                twice.add(token)
            else:
                self.birth[token], self.left[token], self.right[token] = rank, a, b
                symbols[token] = symbols[a] + symbols[b]
            ranks[a, b] = (rank, token)
        self.ranks = ranks
        keys = np.array([a << WIDTH | b for a, b in ranks], np.uint64)
        self.rank_of = Table(len(keys)).add(keys, np.array([r for r, _ in ranks.values()], np.int32))
        self.made = np.zeros(len(model["merges"]), np.int64)
        for rank, token in ranks.values():
            self.made[rank] = token
        self.token_text = [""] * size
        for text, token in vocab.items():
            self.token_text[token] = text
        # A token is proposed only if its own symbols merge to it.
        merged = np.flatnonzero(self.birth >= 0)
        sound = np.zeros(size, bool)
        sound[self.base[self.base >= 0]] = True
        sound[merged] = self.holds(self.left[merged], self.right[merged], self.birth[merged])
        for token in merged[np.argsort(self.birth[merged])]:
            sound[token] &= bool(sound[self.left[token]] and sound[self.right[token]]) and token not in twice
        self._trie({t: s for t, s in symbols.items() if sound[t]})

    def _trie(self, symbols: dict[int, tuple[int, ...]]) -> None:
        nodes: dict[int, int] = {}
        tokens = [-1]
        for token, word in symbols.items():
            at = 0
            for s in word:
                key = at << 9 | s
                nxt = nodes.get(key)
                if nxt is None:
                    nxt = nodes[key] = len(tokens)
                    tokens.append(-1)
                at = nxt
            tokens[at] = token
        self.step = Table(len(nodes)).add(np.fromiter(nodes, np.uint64, len(nodes)), np.fromiter(nodes.values(), np.int32, len(nodes)))
        self.token_at = np.array(tokens, np.int32)

    def holds(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the border between tokens ``a`` and ``b`` (before rank ``until``).

        Walks back in time through the pairs of parts that touched at the border: the part that came into being last is
        replaced by its half at the border. A merge of such a pair would have come first if its rank lies below the rank at
        which either part was merged away; at equal ranks the one further left comes first.
        """
        out = np.ones(len(a), bool)
        x, y = a.astype(np.int64), b.astype(np.int64)
        end = np.full(len(a), NEVER, np.int32) if until is None else until.astype(np.int32)
        x_end, y_end, open_ = end, end.copy(), np.arange(len(a))
        while len(open_):
            rank = self.rank_of[(x << WIDTH | y).astype(np.uint64)]
            crossed = (rank >= 0) & (rank < x_end) & (rank <= y_end)
            out[open_[crossed]] = False
            from_x, from_y = self.birth[x], self.birth[y]
            more = ~crossed & ((from_x >= 0) | (from_y >= 0))
            x, y, x_end, y_end, from_x, from_y, open_ = (v[more] for v in (x, y, x_end, y_end, from_x, from_y, open_))
            back = from_x > from_y
            x_end, y_end = np.where(back, from_x, x_end), np.where(back, y_end, from_y)
            x, y = np.where(back, self.right[x], x), np.where(back, y, self.left[y])
        return out

    def holds_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``holds``, each different pair once."""
        pairs, where = np.unique(a.astype(np.int64) << WIDTH | b, return_inverse=True)
        return self.holds(pairs >> WIDTH, pairs & ((1 << WIDTH) - 1))[where]

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All symbols of the words, and where each word begins (and the last ends)."""
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        bounds = offsets_of(np.fromiter(map(len, words), np.int64, len(words)))
        if self.ending and len(flat):
            flat[bounds[1:][np.diff(bounds) > 0] - 1] += 256
        return flat, bounds

    def merge(self, symbols: Iterable[int]) -> list[int]:
        """Exact merging of one word, lowest rank first, leftmost first."""
        tokens = [int(t) for t in self.base[list(symbols)] if t >= 0]
        ranks = self.ranks
        if len(tokens) > 48:
            return self._merge_long(tokens)
        while len(tokens) > 1:
            best, at = NEVER, -1
            for i in range(len(tokens) - 1):
                found = ranks.get((tokens[i], tokens[i + 1]))
                if found and found[0] < best:
                    best, at, token = found[0], i, found[1]
            if at < 0:
                break
            tokens[at : at + 2] = [token]
        return tokens

    def _merge_long(self, tokens: list[int]) -> list[int]:
        after, before = [*range(1, len(tokens)), -1], [*range(-1, len(tokens) - 1)]
        heap = [(*self.ranks[p], i)[::2] for i, p in enumerate(zip(tokens, tokens[1:], strict=False)) if p in self.ranks]
        heapq.heapify(heap)
        gone = [False] * len(tokens)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0:
                continue
            found = self.ranks.get((tokens[i], tokens[j]))
            if not found or found[0] != rank:
                continue
            tokens[i], gone[j], after[i] = found[1], True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (found := self.ranks.get((tokens[k], tokens[after[k]]))):
                    heapq.heappush(heap, (found[0], k))
        return [t for t, dead in zip(tokens, gone, strict=True) if not dead]

    def merge_all(self, flat: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Exact merging of many words at once; each round does the next merge of every word."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * (len(bounds) - 1)
        sizes = np.diff(bounds)
        for w in np.flatnonzero(sizes > 48):
            out[w] = np.array(self.merge(flat[bounds[w] : bounds[w + 1]]), np.int64)
        short = np.flatnonzero(sizes <= 48)
        tokens, word = self.base[flat[ragged(bounds[:-1][short], sizes[short])]].astype(np.int64), np.repeat(short, sizes[short])
        word, tokens = word[tokens >= 0], tokens[tokens >= 0]
        while len(tokens):
            rank = np.full(len(tokens), NEVER, np.int64)
            near = np.flatnonzero(word[1:] == word[:-1])
            found = self.rank_of[(tokens[near] << WIDTH | tokens[near + 1]).astype(np.uint64)]
            rank[near[found >= 0]] = found[found >= 0]
            begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank << 32 | np.arange(len(tokens)), begins)
            merging = (best >> 32) < NEVER
            done = np.repeat(~merging, np.diff(np.r_[begins, len(tokens)]))
            for w, ids in zip(word[begins[~merging]].tolist(), np.split(tokens[done], np.flatnonzero(np.diff(word[done])) + 1), strict=False):
                out[w] = ids
            at = best[merging] & 0xFFFFFFFF
            tokens[at] = self.made[best[merging] >> 32]
            done[at + 1] = True
            tokens, word = tokens[~done], word[~done]
        return out

    def longest(self, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words: tokens in order, and where each word's tokens begin."""
        at, stop, word = bounds[:-1].copy(), bounds[1:], np.flatnonzero(np.diff(bounds))
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        while len(word):
            pos, end = at[word], stop[word]
            node, best, size = np.zeros(len(word), np.int64), np.full(len(word), -1, np.int32), np.zeros(len(word), np.int64)
            live, k = np.arange(len(word)), 0
            while len(live):
                node_next = self.step[(node[live] << 9 | flat[pos[live] + k]).astype(np.uint64)]
                live = live[node_next >= 0]
                node[live] = node_next[node_next >= 0]
                token = self.token_at[node[live]]
                hit = live[token >= 0]
                best[hit], size[hit] = token[token >= 0], k + 1
                k += 1
                live = live[pos[live] + k < end[live]]
            missing = best < 0  # a byte that the vocabulary lacks is left out, as the library does
            size[missing] = 1
            taken.append((word[~missing], best[~missing]))
            at[word] += size
            word = word[at[word] < end]
        if not taken:
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        words = np.concatenate([w for w, _ in taken])
        tokens = np.concatenate([t for _, t in taken])
        order = np.argsort(words, kind="stable")
        return tokens[order], offsets_of(np.bincount(words, minlength=len(bounds) - 1))

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words in order, and where each word's tokens begin (and the last end)."""
        flat, bounds = self.symbols(words)
        tokens, starts = self.longest(flat, bounds)
        if len(tokens) < 2:
            return tokens, starts
        word = np.repeat(np.arange(len(words)), np.diff(starts))
        inner = np.flatnonzero(word[1:] == word[:-1])
        failed = np.unique(word[inner[~self.holds_all(tokens[inner], tokens[inner + 1])]])
        lacking = np.unique(np.searchsorted(bounds, np.flatnonzero(self.base[flat] < 0), side="right") - 1)
        failed = np.union1d(failed, lacking)
        if not len(failed):
            return tokens, starts
        sizes = np.diff(bounds)[failed]
        exact = self.merge_all(flat[ragged(bounds[:-1][failed], sizes)], offsets_of(sizes))
        lengths = np.diff(starts)
        lengths[failed] = [len(t) for t in exact]
        out, begins = np.empty(int(lengths.sum()), np.int32), offsets_of(lengths)
        good = np.ones(len(words), bool)
        good[failed] = False
        out[ragged(begins[:-1][good], lengths[good])] = tokens[ragged(starts[:-1][good], lengths[good])]
        out[ragged(begins[:-1][failed], lengths[failed])] = np.concatenate(exact)
        return out, begins


class WordCodec(Known):
    """Encodes and decodes texts for a vocabulary whose words end in a mark and whose white space is dropped."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.merges = Merges(path)
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        parts = spec["pre_tokenizer"]["pretokenizers"]
        self.pieces = regex.compile(parts[0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.letters = byte_letters()
        self.forget()

    def forget(self) -> None:
        super().forget()
        self.ids, self.decoded, self.tokens = Runs(np.uint8), Runs(np.uint8), Growing(np.int64)

    def _pieces(self, chunk: str) -> list[bytes]:
        """The words of a stretch of text without white space and special tokens."""
        if PLAIN.fullmatch(chunk):
            return [p.encode() for p in self.pieces.findall(chunk.lower())]
        normal = self.library.normalizer.normalize_str(chunk)
        return [bytes(self.letters[c] for c in p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _parts(self, chunk: str) -> list[tuple[list[bytes], str]]:
        """Words of the stretches between special tokens, and the special tokens themselves."""
        if not any(x in chunk for x in self.special):
            return [(self._pieces(chunk), "")]
        return [([], x) if x in self.special else (self._pieces(x), "") for x in self.cut.split(chunk) if x]

    def learn(self, parts: list[bytes]) -> None:
        words: dict[bytes, int] = {}
        rows = []
        for part in parts:
            rows.append([
                x for some, special in self._parts(part.decode())
                for x in ([special] if special else [words.setdefault(p, len(words)) for p in some])
            ])
        tokens, starts = self.merges.encode(list(words))
        ids, bounds = tokens.tolist(), starts.tolist()
        counts = [b - a for a, b in zip(bounds, bounds[1:], strict=False)]
        self.tokens.extend(np.fromiter((sum(1 if isinstance(x, str) else counts[x] for x in row) for row in rows), np.int64, len(rows)))
        for runs, names, fixed in (
            (self.ids, [str(t) for t in ids], {t: str(i) for t, i in self.special.items()}),
            (self.decoded, [self.merges.token_text[t] for t in ids], {t: t for t in self.special}),
        ):
            joined = [" ".join(names[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            made = [
                (joined[row[0]] if len(row) == 1 and not isinstance(row[0], str)
                 else " ".join(filter(None, (fixed[x] if isinstance(x, str) else joined[x] for x in row)))).encode()
                for row in rows
            ]
            made = [x + b" " if x else x for x in made]
            runs.extend(np.frombuffer(b"".join(made), np.uint8), np.fromiter(map(len, made), np.int64, len(made)))

    def encode(self, column: pa.Array) -> Iterator[tuple[int, memoryview, memoryview]]:
        """Of each text: number of tokens, ids, and decoded tokens, both joined by one space, in UTF-8."""
        data, bounds = text_bytes(column)
        starts, ends, counts = cut_at_white(data, bounds, [t.encode() for t in self.special])
        at = self.number(data, starts, ends)
        texts = offsets_of(counts)
        n = np.diff(offsets_of(self.tokens.all[at])[texts])
        ids, decoded = (memoryview(runs.take(at)) for runs in (self.ids, self.decoded))
        cut_ids, cut_decoded = (offsets_of(runs.lengths(at))[texts].tolist() for runs in (self.ids, self.decoded))
        for i, k in enumerate(n.tolist()):
            yield k, ids[cut_ids[i] : max(cut_ids[i], cut_ids[i + 1] - 1)], decoded[cut_decoded[i] : max(cut_decoded[i], cut_decoded[i + 1] - 1)]


@lru_cache(2)
def word_codec(path: str) -> WordCodec:
    return WordCodec(path)


def encode_words(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of every whole text: (id, token_ids string, decoded string), one row per input row.

    Ids are decimal and joined by one space, as is the decoded text's sequence of tokens (special tokens stay). Null and empty
    texts have no tokens and decode to an empty text. Ids may be null or repeated; further columns of ``df`` are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = word_codec(path)
        for batch in slices(batches):
            rows = [(str(x, "utf-8"), str(y, "utf-8")) for _, x, y in codec.encode(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in rows], pa.string()), pa.array([y for _, y in rows], pa.string())],
                [id_col, "token_ids", "decoded"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, text_col), work, f"`{id_col}` {kind}, token_ids string, decoded string")


def digest_words(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of ``encode_words``, without moving the encoded text out of the task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = word_codec(path)
        for batch in slices(batches):
            rows = [
                (n, hashlib.sha256(x).hexdigest(), hashlib.sha256(y).hexdigest()) for n, x, y in codec.encode(batch.column(1))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string())))],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(
        df.select(id_col, text_col), work, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )

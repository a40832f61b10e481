"""Encoding, counting, packing and files, against the libraries."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lanternlog.llm import bpe, byte_ids, known, packing, token_counts, token_files
from lanternlog.session import new_path
from llm import odd

SF01 = "/root/testdata/sf0.01"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORD)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return np.array(ids, "<u4").tobytes()


SNIPPETS = st.lists(
    st.one_of(
        st.sampled_from(["the", " the", "ing", "  ", "\n", " \n ", "<|endoftext|>", "'s", "'S", "12", " 3", "é", "ß", "...", "--", "aaa", " ", " ", "İ", "Σ"]),
        st.text(max_size=6),
    ),
    max_size=12,
).map("".join)


@settings(max_examples=150, deadline=None)
@given(SNIPPETS)
def test_any_text_encodes_as_the_libraries_do(text):
    byte, word = byte_ids.byte_ids(BYTE), bpe.word_codec(WORD)
    column = pa.array([text])
    expected = ids_of(byte.library, text)
    assert byte.encode(column)[0].tolist() == expected
    table = token_counts.counter(BYTE)
    numbers, _ = table.stretches(column)
    assert int(table.totals.all[numbers].sum()) == len(expected)
    ((n, ids, decoded),) = word.encode(column)
    expected = ids_of(word.library, text)
    assert (n, str(ids, "utf-8")) == (len(expected), " ".join(map(str, expected)))
    assert str(decoded, "utf-8") == word.library.decode(expected, skip_special_tokens=False)


def test_every_character_is_cut_as_the_library_cuts_it(byte_library):
    """Between a word and a word, and between spaces, for all code points but surrogates."""
    codes = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [x for c in codes[::7] for x in (f"a {chr(c)} b", f"a{chr(c)} {chr(c)}b")]
    byte = byte_ids.byte_ids(BYTE)
    for a in range(0, len(texts), 4000):
        some = texts[a : a + 4000]
        ids, begins = byte.encode(pa.array(some))
        expected = byte_library.encode_batch_fast(some, add_special_tokens=False)
        assert [ids[x:y].tolist() for x, y in zip(begins, begins[1:], strict=False)] == [e.ids for e in expected]


def test_equal_hashes_do_not_mix_up_stretches(monkeypatch):
    one = np.ones(256, np.uint64), np.ones(4096, np.uint64)
    monkeypatch.setattr(known, "_mixers", lambda: one)
    byte = byte_ids.ByteIds(BYTE)
    texts = ["ab ba abc cba xy yx", "ba ab yx xy cab", "ab ba"]
    for _ in range(2):
        ids, begins = byte.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:], strict=False)] == [ids_of(byte.library, t) for t in texts]


def test_merging_all_at_once_equals_merging_one_by_one():
    merges = bpe.word_codec(WORD).merges
    words = [w.encode() for w in "thonanding aaaaaaaaaaaa unbelievableness mississippi zzxxqq ---- lorem".split()]
    flat, bounds = merges.symbols(words)
    expected = [merges.merge(flat[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    assert [x.tolist() for x in merges.merge_all(flat, bounds)] == expected
    tokens, starts = merges.encode(words)
    assert [tokens[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == expected


def test_prefix_counts_are_those_of_encoded_prefixes(byte_library):
    table = token_counts.counter(BYTE)
    text = "Thereupon, unthinkingly: 12345 misunderstandings!!! Naïveté\nand  so on"
    counts = table.prefix_table(text)
    for i in range(1, len(text) + 1):
        if text[:i].isascii() and not text[i - 1].isspace():
            assert counts[len(text[:i].encode()) - 1] == len(ids_of(byte_library, text[:i])), text[:i]


def test_encode_words(spark, word_library):
    rows = bpe.encode_words(odd.frame(spark), WORD).collect()
    by_text = {(i, t or "") for i, t in odd.texts()}
    assert len(rows) == len(odd.texts())
    expected = defaultdict(list)
    for i, t in odd.texts():
        ids = ids_of(word_library, t)
        expected[i].append((" ".join(map(str, ids)), word_library.decode(ids, skip_special_tokens=False)))
    found = defaultdict(list)
    for r in rows:
        found[r.doc_id].append((r.token_ids, r.decoded))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()} and by_text
    digests = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest_words(odd.frame(spark), WORD).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert digests == {(k, len(a.split()), sha(a), sha(b)) for k, v in expected.items() for a, b in v}


def test_count_tokens(spark, byte_library):
    rows = token_counts.count_tokens(odd.frame(spark), BYTE, limit=20).collect()
    expected = sorted((i is None, i or 0, len((t or "").encode()), len(ids_of(byte_library, t))) for i, t in odd.texts())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows) == expected
    for r in rows:
        assert r.over_limit == (r.n_tokens > 20) and (r.fit_bytes < r.n_bytes) == r.over_limit


def test_fitting_bytes_fit(byte_library):
    table = token_counts.counter(BYTE)
    text = "Thereupon unthinkingly, the misunderstandings of 12345 people went on and on"
    for limit in range(0, 16):
        at, _ = table.stretches(pa.array([text]))
        n = table.fitting_bytes(at, limit)
        assert len(ids_of(byte_library, text[:n])) <= limit
        assert n == len(text) or len(ids_of(byte_library, text[: n + 1])) > limit


def test_token_files(spark, byte_library):
    for rows in (odd.texts(), []):
        folder = new_path(spark, "files")
        manifest = token_files.write_tokens(odd.frame(spark, rows), BYTE, folder, end=0, parts=5)
        expected, start = [], 0
        for i, t in sorted(((i if i is not None else -1, t) for i, t in rows), key=lambda x: (x[0], x[1] is not None, x[1] or "")):
            ids = [*ids_of(byte_library, t), 0]
            expected.append((None if i < 0 else i, start, len(ids), packed(ids)))
            start += len(ids)
        found = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
        assert [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in found] == expected
        assert manifest["total"] == start


def test_levels_choose_the_smallest_sum_of_squares():
    rng = np.random.default_rng(1)
    levels = packing.Levels(16)
    for _ in range(300):
        size = int(rng.integers(1, 16))
        before = levels.counts.copy()

        def after(level, before=before, size=size):
            counts = before.copy()
            if level:
                counts[level] -= 1
            if level + size < 16:
                counts[level + size] += 1
            return int((counts[1:16] ** 2).sum())

        choices = [0, *(h for h in range(1, 17 - size) if before[h])]
        level = levels.choose(size)
        assert level in choices and after(level) == min(map(after, choices))
        levels.put((0, 1, 0, np.zeros(size, np.uint32)))


def check_pieces(rows, texts, library, window):
    expected = defaultdict(list)
    for i, t in texts:
        expected[i].append(packed([*ids_of(library, t), 1]))
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.length > 0
        sequences[r.sequence_id].append(r)
        docs[r.doc_id].append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at
            at += r.length
        assert at <= window and (at == window or at & (at - 1) == 0)
    for key, pieces in docs.items():
        pool = b"".join(bytes(r.ids) for r in sorted(pieces, key=lambda r: (r.doc_tokens, r.start)))
        assert len(pool) == sum(map(len, expected[key]))
        if len(expected[key]) == 1:
            assert pool == expected[key][0]
            assert all(r.doc_tokens == len(pool) // 4 for r in pieces)
    assert set(docs) == set(expected)


def test_pack(spark, byte_library):
    for window in (64, 2048):
        check_pieces(packing.pack(odd.frame(spark), BYTE, window).collect(), odd.texts(), byte_library, window)
    assert packing.pack(odd.frame(spark, []), BYTE).count() == 0
    with_crc = packing.pack(odd.frame(spark), BYTE).select("ids", F.crc32("ids").alias("crc")).collect()
    assert all(r.crc == zlib.crc32(bytes(r.ids)) for r in with_crc)


def test_small_partitions_still_fill_windows_by_levels(spark, byte_library, monkeypatch):
    """Over 32 small partitions most ids leave in windows that the level array filled, and nothing is padded but powers of two."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(32)
    pieces = packing.pack(table, BYTE).collect()
    check_pieces(pieces, docs, byte_library, 2048)
    total = sum(r.length for r in pieces)
    first = sum(r.length for r in pieces if r.sequence_id >> 32 < 32)
    # What the second pass places: its windows that were cut are the fullest-first rest, with pieces that start inside a document.
    lengths = defaultdict(int)
    for r in pieces:
        lengths[r.sequence_id] += r.length
    assert sum(n for n in lengths.values() if n == 2048) > 0.99 * total
    whole = defaultdict(list)
    for r in pieces:
        whole[r.sequence_id].append(r)
    cut = {i for i, rows in whole.items() if i >> 32 >= 32 and any(r.start % 2048 for r in rows)}
    by_levels = first + sum(lengths[i] for i in whole if i >> 32 >= 32 and i not in cut)
    assert by_levels > 0.5 * total
    monkeypatch.setattr(packing, "LEFTOVER_IDS", 100_000)
    check_pieces(packing.pack(table, BYTE).collect(), docs, byte_library, 2048)

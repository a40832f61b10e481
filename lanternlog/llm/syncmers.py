"""Closed syncmers: k-mers whose smallest inner s-mer is their first or last, chosen without looking at their surroundings.

The same passage therefore gives the same anchors wherever it stands, and texts can be compared by their anchors. A fingerprint
keeps the hashes of all anchors of the whole text in their order, and two texts are alike as far as anchors match in order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternlog.llm.common import map_batches, shuffle_parts, slices, texts_of

#: Length of the inner strings is fixed at three code points (63 bits); an anchor is three of them long.
INNER, LENGTH = 3, 9


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions (code points) and hashes of the closed syncmers. A text without any is one anchor as a whole."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes)
    if n >= LENGTH:
        order = _mixed(codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:])
        low = np.minimum(order[:-1], order[1:])
        low = np.minimum(low[:-2], low[2:])
        low = np.minimum(low[:-3], low[3:])  # of the seven inner strings of each k-mer
        at = np.flatnonzero((order[: len(low)] == low) | (order[LENGTH - INNER :] == low))
        if len(at):
            hashes = order[at] * np.uint64(3) + order[at + 3] * np.uint64(0xBF58476D1CE4E5B9)
            return at, _mixed(hashes + order[at + 6] * np.uint64(0x94D049BB133111EB))
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return np.zeros(1, np.int64), np.frombuffer(whole, np.uint64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The hashes of all anchors in the order of their positions, cut to 32 bits."""
    return (hashes >> np.uint64(32)).astype(np.uint32)


def _occurrences(x: np.ndarray) -> np.ndarray:
    """Hashes with their number among equal ones, as one key each."""
    order = np.argsort(x, kind="stable")
    ranked = x[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    number = np.empty(len(x), np.uint64)
    number[order] = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)]))
    return x.astype(np.uint64) << np.uint64(32) | number


def matched(a: np.ndarray, b: np.ndarray) -> int:
    """Most anchors that match in the same order in both: the n-th of a hash with the n-th of that hash."""
    short = min(len(a), len(b))
    apart = np.flatnonzero(a[:short] != b[:short])
    same = int(apart[0]) if len(apart) else short
    a, b = a[same:], b[same:]
    if not len(a) or not len(b):
        return same
    _, at, to = np.intersect1d(_occurrences(a), _occurrences(b), assume_unique=True, return_indices=True)
    ends: list[int] = []  # smallest end of an increasing run of each length
    for place in to[np.argsort(at)].tolist():
        i = bisect_left(ends, place)
        if i == len(ends):
            ends.append(place)
        else:
            ends[i] = place
    return same + len(ends)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of anchors of two texts that match in order, of all anchors of both; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = matched(a, b)
    return common / (len(a) + len(b) - common)


def as_text(kept: np.ndarray) -> str:
    return kept.astype(">u4").tobytes().hex()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, positions, hashes, fingerprint) of every whole text, one row per input row.

    ``positions`` and ``hashes`` list all anchors; ``fingerprint`` is the hexadecimal sketch, eight digits an anchor. Null and empty texts have
    no anchors and an empty fingerprint.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch)
            found = [anchors(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([p for p, _ in found], pa.list_(pa.int64())),
                    pa.array([h.view(np.int64) for _, h in found], pa.list_(pa.int64())),
                    pa.array([as_text(sketch(h)) for _, h in found], pa.string()),
                ],
                [id_col, "n_chars", "positions", "hashes", "fingerprint"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_chars bigint, positions array<bigint>, hashes array<bigint>, fingerprint string"
    return map_batches(df.select(id_col, text_col), work, schema)


def _range_of(key: Column, bounds: list[int], leaves: list[Column]) -> Column:
    """The leaf of the range that holds ``key``: a balanced tree of comparisons."""
    if not bounds:
        return leaves[0]
    mid = len(bounds) // 2
    return F.when(key < bounds[mid], _range_of(key, bounds[:mid], leaves[: mid + 1])).otherwise(
        _range_of(key, bounds[mid + 1 :], leaves[mid + 1 :])
    )


def compare_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The edited text has its last floor(n / 2) code points replaced by as many first ones (or all) of the next document in
    ascending order of ``id_col``; the last document is followed by the first. Rows that repeat an id are ordered by text, null
    ids come first, null texts are empty. Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. Documents are dealt out by ranges of ids, and the first document of each range is copied to the range before
    it, so every text is shuffled once.
    """
    spark = df.sparkSession
    least = -(2**63)
    keyed = df.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    keyed = keyed.withColumn("_key", F.coalesce("_id", F.lit(least)))
    wanted = 4 * shuffle_parts(spark)
    cuts = keyed.approxQuantile("_key", [i / wanted for i in range(1, wanted)], 0.1 / wanted)
    bounds = sorted({int(c) for c in cuts})
    numbered = _range_of(F.col("_key"), bounds, [F.lit(i) for i in range(len(bounds) + 1)])
    heads = {r["part"]: r["head"] for r in keyed.groupBy(numbered.alias("part")).agg(F.min("_key").alias("head")).collect()}
    filled = sorted(heads)
    before = {part: filled[i - 1] for i, part in enumerate(filled)}
    leaves = []
    for part in range(len(bounds) + 1):
        own = F.struct(F.lit(part).alias("part"), F.lit(0).alias("copy"))
        copied = F.struct(F.lit(before.get(part, 0)).alias("part"), F.lit(1).alias("copy"))
        leaves.append(F.when(F.col("_key") == heads.get(part, least), F.array(own, copied)).otherwise(F.array(own)))
    dealt = (
        keyed.select("_id", "_text", "_key", F.explode(_range_of(F.col("_key"), bounds, leaves)).alias("to"))
        .select("_id", "_text", "_key", "to.part", "to.copy")
        .repartition(shuffle_parts(spark), "part")
        .sortWithinPartitions("part", "copy", "_key", "_text")
        .select("_id", "_text", "part", "copy")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the document that waits for its next one: id, text, part, sketch
        for batch in slices(batches):
            out: list[tuple] = []
            for key, text, part, copy in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if copy and (last is None or last[2] != part):
                    continue  # a further row with the id of the range's first document
                own = sketch(anchors(text)[1])
                if last is not None and last[2] == part:
                    half = len(last[1]) // 2
                    edited = last[1][: len(last[1]) - half] + text[:half]
                    other = sketch(anchors(edited)[1])
                    out.append((
                        last[0], len(last[1]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                        as_text(last[3]), as_text(other), likeness(last[3], other), likeness(last[3], own),
                    ))
                last = None if copy else (key, text, part, own)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names
                )

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = (
        f"`{id_col}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return map_batches(dealt, work, schema)

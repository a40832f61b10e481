"""SimHash near-duplicates through an inverted index of byte positions.

Two 64-bit fingerprints that differ in at most two bits share at least six of their eight bytes, in place. The index holds every
choice of six positions with their bytes, so a pair that meets in a posting has reached the guaranteed number of matches; the
number of shared bytes is then counted, and the differing bits are verified. A posting fixes 48 bits, so it holds at most
2^16 different fingerprints whatever the number of documents. Copies share a fingerprint and enter the index once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternlog.llm.common import components, map_batches, min_labels, shuffle_parts, slices, stored
from lanternlog.llm.merkle import leaf_digest

WORDS, SEED, BITS, BYTES = 3, 42, 2, 8
#: Postings up to this size compare all their members; larger ones link them through their neighbours' values.
SMALL = 32
#: Bits of each choice of byte positions.
CHOICES = [
    sum(0xFF << (8 * p) for p in places) for places in combinations(range(BYTES), BYTES - BITS)
]


def simhash(text: bytes) -> int:
    """Fingerprint of a text: a bit is set if over half of its shingles' hashes have it; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= WORDS:
        hashes = [xxhash.xxh64_intdigest(flat, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[: -WORDS]]).tolist()
        hash_of = xxhash.xxh64_intdigest
        hashes = [hash_of(flat[a:b], SEED) for a, b in zip(starts, (ends[WORDS - 1 :] - 1).tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(len(hashes), 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the signed 64-bit SimHash of every whole text; null counts as empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            values = np.array([simhash(t or b"") for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], [id_col, "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, text_col), work, f"`{id_col}` {kind}, fp bigint")


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairs that share enough bytes and differ in few enough bits."""
    differing = x ^ y
    shared = (differing.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    return (shared >= BYTES - BITS) & (np.bitwise_count(differing) <= BITS)


def _posting_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected inside one large posting, without listing its pairs.

    Members that differ in at most two bits have a common value at most one bit away from both; all members that reach a
    value are linked to the first that does. Any two of them differ in at most two bits.
    """
    free = np.flatnonzero(np.unpackbits((fps ^ fps[0]).view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").any(axis=0))
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << free.astype(np.uint64)])
    reached = (fps[:, None] ^ flips[None, :]).ravel()
    member = np.repeat(np.arange(len(fps)), len(flips))
    order = np.argsort(reached, kind="stable")
    reached, member = reached[order], member[order]
    first = np.flatnonzero(np.r_[True, reached[1:] != reached[:-1]])
    a, b = np.repeat(member[first], np.diff(np.r_[first, len(reached)])), member
    root = min_labels(a, b, len(fps))
    rest = np.flatnonzero(root != np.arange(len(fps)))
    return root[rest], rest


def posting_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of representatives from rows (choice, posting, fp, rep) sorted by choice, posting and fp."""
    held: list[np.ndarray] = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64)]

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        choice, posting, fp, rep = rows
        fp = fp.view(np.uint64)
        begins = np.flatnonzero(np.r_[True, (choice[1:] != choice[:-1]) | (posting[1:] != posting[:-1])])
        sizes = np.diff(np.r_[begins, len(fp)])
        left, right = [], []
        for i in np.flatnonzero(sizes > SMALL):
            a, b = _posting_links(fp[begins[i] : begins[i] + sizes[i]])
            left.append(rep[begins[i] + a])
            right.append(rep[begins[i] + b])
        remaining = np.repeat(begins + sizes, sizes) - np.arange(len(fp))
        remaining[np.repeat(sizes > SMALL, sizes)] = 0
        for lag in range(1, SMALL):
            at = np.flatnonzero(remaining > lag)
            if not len(at):
                break
            at = at[_near(fp[at], fp[at + lag])]
            left.append(rep[at])
            right.append(rep[at + lag])
        columns = [np.concatenate([np.zeros(0, np.int64), *side]) for side in (left, right)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b"])

    for batch in batches:
        rows = [np.concatenate([h, np.asarray(batch.column(i))]) for i, h in enumerate(held)]
        if not len(rows[0]):
            continue
        # The last posting may go on in the next batch; it has at most 2^16 members.
        other = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        held = [r[cut:] for r in rows]
        if cut:
            yield links([r[:cut] for r in rows])
    if len(held[0]):
        yield links(held)


def _linked(classes: DataFrame) -> DataFrame:
    """(node, component) of the representatives of (fp, rep) whose fingerprints have links."""
    postings = classes.select(
        F.explode(F.array([F.struct(F.lit(i).cast("bigint").alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(c))).alias("posting"))
                           for i, c in enumerate(CHOICES)])).alias("key"), "fp", "rep",
    ).select("key.choice", "key.posting", "fp", "rep")
    dealt = postings.repartition(shuffle_parts(classes.sparkSession), "choice", "posting").sortWithinPartitions("choice", "posting", "fp")
    return components(map_batches(dealt, posting_links, "a bigint, b bigint"), "a", "b")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row: fingerprints that differ in at most two bits are linked.

    ``component_id`` is the smallest id reachable, the row's own included. Null, empty and blank texts have fingerprint zero and
    are linked like any other. A repeated id may stand for several texts; each row gets the component of its own text. A row
    without id takes the component of its fingerprint, which is null if no row with an id has that fingerprint. Copies are one member of the index, so a group of any size
    adds one row to it, and only links between different fingerprints are searched for components.
    """
    prints = stored(fingerprints(df.select(F.col(id_col).cast("bigint").alias(id_col), text_col), id_col, text_col), "prints")
    classes = stored(prints.filter(f"`{id_col}` is not null").groupBy("fp").agg(F.min(id_col).alias("rep")), "classes")
    linked = _linked(classes)
    found = stored(
        classes.join(linked, classes.rep == linked.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id")),
        "components",
    )
    return prints.join(found, "fp", "left").select(id_col, "fp", "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` for each group that ``near_duplicates`` links, with all columns.

    The row with the smallest id stays; null ids come last, and rows that repeat an id are ordered by a digest of all their
    columns. Decisions are made per row: another text under the id of a row that goes, or stays, is decided by its own
    group. Of equal rows one stays. Null, empty and blank texts are one group. An empty table gives no rows.
    """
    digest = leaf_digest([F.col(f"`{c}`") for c in df.columns])
    keyed = df.select(F.struct(F.col(id_col).cast("bigint").alias("id"), digest.alias("digest")).alias("key"), text_col)
    prints = stored(fingerprints(keyed, "key", text_col), "prints")
    rows = prints.groupBy("fp", "key.id", "key.digest").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest", "n")).alias("first")
    classes = stored(rows.groupBy("fp").agg(first), "classes")
    linked = _linked(classes.select("fp", F.col("fp").alias("rep")))
    grouped = classes.join(linked, classes.fp == linked.node, "left").groupBy(F.coalesce("component", "fp").alias("group"))
    chosen = stored(grouped.agg(F.min("first").alias("first")).select(F.col("first.digest").alias("_digest"), F.col("first.n").alias("_n")), "chosen")
    kept = df.withColumn("_digest", digest).join(chosen, "_digest")
    single = kept.filter("_n = 1").select(*df.columns)
    if chosen.filter("_n > 1").isEmpty():
        return single
    return single.unionByName(kept.filter("_n > 1").select(*df.columns).distinct())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hex_fingerprint(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))

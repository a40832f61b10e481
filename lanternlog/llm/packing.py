"""Sum-of-squares packing: each document goes to the fill level that keeps the level array's sum of squares smallest.

A task fills windows from the documents of its partition. What is left in its open windows when it ends is placed once more, by the same
rule, in fewer tasks that each hold the leftovers of many; only what these leave open is cut to fill windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternlog.llm.byte_ids import byte_ids
from lanternlog.llm.common import map_batches, slices, stored

Piece = tuple[object, int, int, np.ndarray]  # document, its number of ids, start in it, ids
#: Ids that a task of the second pass aims to place.
LEFTOVER_IDS = 4 << 20


class Levels:
    """Open windows by fill level; ``counts[h]`` of them hold ``h`` ids."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]

    def choose(self, size: int) -> int:
        """Level of the window to put ``size`` ids into; 0 for a new one.

        Moving a window from level h to h + size changes the sum of squared counts by 2 (counts[h + size] - counts[h]) + 2,
        filling it by 1 - 2 counts[h], and a new window by 2 counts[size] + 1. Ties go to the fullest window.
        """
        top = self.window - size
        here = self.counts[1 : top + 1]
        change = 2 * (self.counts[size + 1 :] - here) + 2
        change[-1] -= 1
        change[here == 0] = np.iinfo(np.int64).max
        best = top - 1 - int(np.argmin(change[::-1]))
        return best + 1 if change[best] <= 2 * self.counts[size] + 1 else 0

    def put(self, piece: Piece) -> list[Piece] | None:
        """Place a piece shorter than a window; a window that it fills is closed and returned."""
        size = len(piece[3])
        level = self.choose(size)
        pieces = self.open[level].pop() if level else []
        pieces.append(piece)
        if level:
            self.counts[level] -= 1
        if level + size == self.window:
            return pieces
        self.counts[level + size] += 1
        self.open[level + size].append(pieces)
        return None

    def left(self) -> list[Piece]:
        """Take the pieces of all open windows, fullest first."""
        pieces = [p for level in reversed(self.open) for window in level for p in window]
        self.__init__(self.window)
        return pieces

    def rest(self) -> Iterator[list[Piece]]:
        """Empty all open windows: their pieces are cut so that they fill windows, the last ids powers of two."""
        pieces = self.left()
        left = sum(len(p[3]) for p in pieces)
        pieces.reverse()
        while left:
            size = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            left -= size
            window = []
            while size:
                key, total, start, ids = pieces.pop()
                if len(ids) > size:
                    pieces.append((key, total, start + size, ids[size:]))
                    ids = ids[:size]
                window.append((key, total, start, ids))
                size -= len(ids)
            yield window


def _rows(id_col: str, id_type: pa.DataType, out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True))
    out.clear()
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], id_type), *(pa.array(c, t) for c, t in zip(columns[1:], types, strict=True))],
        [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
    )


def _base() -> int:
    return (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32


def _closed(window: list[Piece], sequence: int | None) -> Iterator[tuple]:
    """Output rows of a window; without a number its pieces are still to be placed."""
    offset = 0
    for key, total, start, ids in window:
        yield key, start, len(ids), ids.astype("<u4").tobytes(), total, sequence, None if sequence is None else offset
        offset += len(ids)


def pack(
    df: DataFrame, path: str, window: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of packed sequences: (id, start, length, ids, doc_tokens, sequence_id, offset).

    A document is its ids by the vocabulary at ``path`` and then ``end``; null and empty texts are that one id. ``ids`` are
    little-endian unsigned 32-bit numbers. Every task packs the documents of its partition in their order with a level array
    of its own, so no key matters; it holds only open windows. Documents longer than a window first give whole windows.

    The first pass is stored. The pieces of its open windows, a bounded number per task, are dealt out evenly over tasks of about
    ``LEFTOVER_IDS`` ids and placed again; what these leave open is cut to fill windows, and the last ids of a task go to
    sequences whose lengths are powers of two, which need no padding. ``sequence_id`` is the task's number, those of the second
    pass after those of the first, times 2^32 plus a running number. Rows that repeat an id are packed as documents of their own;
    ids may be null. An empty table gives no rows.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, levels, base = byte_ids(path), Levels(window), _base()
        out: list[tuple] = []
        sequence, id_type = 0, None
        for batch in slices(batches):
            id_type = batch.column(0).type
            ids, begins = table.encode(batch.column(1), end)
            for key, a, b in zip(batch.column(0).to_pylist(), begins.tolist(), begins[1:].tolist(), strict=False):
                whole = (b - a) // window * window
                for start in range(0, whole, window):
                    out += _closed([(key, b - a, start, ids[a + start : a + start + window])], base + sequence)
                    sequence += 1
                if a + whole < b and (full := levels.put((key, b - a, whole, ids[a + whole : b].copy()))):
                    out += _closed(full, base + sequence)
                    sequence += 1
            if len(out) >= 500:
                yield _rows(id_col, id_type, out)
        left = levels.left()
        for a in range(0, len(left), 500):
            out += _closed(left[a : a + 500], None)
            yield _rows(id_col, id_type, out)
        if out:
            yield _rows(id_col, id_type, out)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, base = Levels(window), _base() + after
        out: list[tuple] = []
        sequence, id_type = 0, None
        for batch in batches:
            id_type = batch.column(0).type
            for key, start, ids, total in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if full := levels.put((key, total, start, np.frombuffer(ids, "<u4"))):
                    out += _closed(full, base + sequence)
                    sequence += 1
            if len(out) >= 500:
                yield _rows(id_col, id_type, out)
        for full in levels.rest():
            out += _closed(full, base + sequence)
            sequence += 1
            if len(out) >= 500:
                yield _rows(id_col, id_type, out)
        if out:
            yield _rows(id_col, id_type, out)

    kind = df.schema[id_col].dataType.simpleString()
    schema = (
        f"`{id_col}` {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    )
    placed = stored(map_batches(df.select(id_col, text_col), first, schema), "packed")
    leftover = placed.filter("sequence_id is null")
    ids, top = placed.agg(
        F.sum(F.when(F.col("sequence_id").isNull(), F.col("length"))), F.max(F.shiftright("sequence_id", 32))
    ).head()
    closed = placed.filter("sequence_id is not null")
    if not ids:
        return closed
    after = ((-1 if top is None else top) + 1) << 32
    dealt = leftover.select(id_col, "start", "ids", "doc_tokens").repartition(-(-ids // LEFTOVER_IDS))
    return closed.unionByName(map_batches(dealt, second, schema))

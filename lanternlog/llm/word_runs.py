"""Periodic runs of words through a dictionary of basic factors.

The dictionary names every stretch of 1, 2, 4, 8, ... words of a document that occurs in it again; a name of twice the length is a
pair of names. At each length, places are sorted by name, so neighbours in that order are successor occurrences. Successors at
most twice the length apart form arithmetic progressions, and their difference is a proposed period.

A period p is taken up at the first length L that reaches it (p <= L < 2p). There a block of neighbouring places with difference p
is the whole stretch that keeps p: a place beside the block has another name, which is the word that breaks the period, and no
smaller period is possible, since the place would have a nearer successor. So extending a proposal is arithmetic (the block, L and
p added up), larger differences wait for the next length, and every run is found once. A run of three periods holds such a
block at that length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternlog.llm.common import map_batches, offsets_of, slices

#: Shortest run in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def find_runs(
    words: np.ndarray, begins: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of all documents, ordered by start and period.

    ``words`` are word numbers of documents one after the other, which begin at ``begins`` (with the end). Takes O(n log n) time
    for each of log n lengths and O(n) memory; places whose name occurs once are left out of all greater lengths.
    """
    n = len(words)
    doc = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    places, names = np.arange(n), doc * (int(words.max(initial=0)) + 1) + words
    named = np.empty(n + 1, np.int64)
    size, found = 1, []
    while len(places):
        order = np.argsort(names, kind="stable")
        names, places = names[order], places[order]
        again = names[1:] == names[:-1]
        at, gap = places[:-1][again], (places[1:] - places[:-1])[again]
        due = (gap <= size) & (2 * gap > size)
        found.append(_progressions(at[due], gap[due], size))
        # Names of twice the length, from places whose names occur again.
        often = np.r_[False, again] | np.r_[again, False]
        named.fill(-1)
        named[places[often]] = np.cumsum(np.r_[True, ~again])[often]
        places = np.sort(places[often])
        places = places[places + size < n]
        far = places + size
        both = (named[far] >= 0) & (doc[places] == doc[far])
        places, far = places[both], far[both]
        names = named[places] * (n + 1) + named[far]
        size *= 2
    start, length, period = (np.concatenate([np.zeros(0, np.int64), *parts]) for parts in zip(*found, strict=True)) if found else (
        np.zeros(0, np.int64),
    ) * 3
    long = (length >= least_words) & (length >= least_periods * period)
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _progressions(at: np.ndarray, gap: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches that keep a period, from places and the differences to their successors."""
    order = np.argsort(at)
    at, gap = at[order], gap[order]
    if not len(at):
        return at, gap, gap
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (gap[1:] != gap[:-1])])
    last = np.r_[first[1:], len(at)] - 1
    return at[first], at[last] - at[first] + size + gap[first], gap[first]


def _kept(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in no run after its first period."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    return np.cumsum(cover[:n]) == 0


def periodic_runs(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS,
    least_periods: int = LEAST_PERIODS, arrange: Callable[[object, int], np.ndarray | None] | None = None,
) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row.

    Words lie between ASCII white space and are compared byte by byte. ``runs`` are maximal stretches with smallest period p
    of at least ``least_words`` words and ``least_periods`` periods, as (start, length, period), ordered by start and period.
    ``collapsed`` are the words, joined by one space, that lie in no run after its first period. ``arrange(id, n)`` may give
    the numbers of the original words that stand at places 0 to n - 1, to search rearranged texts.

    Null, empty and blank texts have no words, no runs and an empty ``collapsed``. Rows are worked on by themselves: repeated
    rows and ids give repeated results, null ids are kept, nothing is shuffled, and an empty table gives no rows. A
    row's memory grows with its own text only.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            split = [(t or b"").split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            if arrange:
                for row, key in enumerate(batch.column(0).to_pylist()):
                    new = arrange(key, len(split[row]))
                    if new is not None:
                        split[row] = list(map(split[row].__getitem__, new.tolist()))
            begins = offsets_of(np.array([len(w) for w in split], np.int64))
            flat = np.empty(int(begins[-1]), object)
            flat[:] = [w for words in split for w in words]
            start, length, period = find_runs(pd.factorize(flat)[0].astype(np.int64), begins, least_words, least_periods)
            keep = _kept(len(flat), start, length, period)
            cuts = np.searchsorted(start, begins).astype(np.int32)
            texts = [
                b" ".join(words if keep[a:b].all() else flat[a:b][keep[a:b]].tolist())
                for words, a, b in zip(split, begins.tolist(), begins[1:].tolist(), strict=False)
            ]
            start = start - np.repeat(begins[:-1], np.diff(cuts))
            runs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
            columns = [
                batch.column(0), pa.array(np.diff(begins)), pa.ListArray.from_arrays(pa.array(cuts), runs),
                pa.array(texts, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_words", "runs", "collapsed"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, text_col), work, f"`{id_col}` {kind}, n_words bigint, runs {RUNS}, collapsed string")


def densest(runs: str = "runs") -> Column:
    """The run with the greatest exact length / period, the first of ``runs`` at ties; null without runs."""
    better = "r.length * best.period > best.length * r.period"
    return F.expr(f"aggregate(slice({runs}, 2, size({runs})), get({runs}, 0), (best, r) -> if({better}, r, best))")


def lines(runs: str = "runs") -> Column:
    """``start,length,period`` and a line feed for every run."""
    return F.expr(f"array_join(transform({runs}, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")

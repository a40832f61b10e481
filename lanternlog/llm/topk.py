"""Exact top-k search by inner product: columnar branch-and-bound over shards in vertical layout.

A shard holds up to 4,096 vectors dimension by dimension. A block of queries adds up its products a few dimensions at a time; what
the dimensions to come can still add is at most the product of the lengths of what remains of both vectors. A candidate whose
product so far and remaining mass together stay below a query's k-th best is dropped. While most candidates live, sums are made for
all of them at once; then the survivors are compacted into a list and only they go on. Bounds are only ever too high, and the k-th
best only rises, so the result is exact.

Queries stay where they are: a task holds a block of them and streams the shards past it, so candidates are not shuffled and a query's
bound is carried from shard to shard. Work is queries times rows, as the question asks; with few queries, each meets parts of
the shards in several tasks, whose best k are merged by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternlog.llm.common import map_batches, shuffle_parts, stored
from lanternlog.session import file_system, new_path

#: Vectors of a shard, queries of a block that meets one, and queries that a task aims to hold.
SHARD, BLOCK, HELD = 16_384, 128, 8192
#: Dimensions that are added up between two tests, and the share of live candidates below which they are compacted.
STEP, SPARSE = 16, 0.1
#: Sums of products below this are exact in double precision.
EXACT = float(1 << 53)
#: Room for the rounding of bounds, which must not come out too low.
SLACK = 1 + 1e-9
LOWEST = np.iinfo(np.int64).min


def scaled(df: DataFrame, factor: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cells): vectors as whole numbers, floor(factor * x); null vectors and those with null or non-finite components go."""
    cell = "cast(x as double)"
    bad = f"exists({vector_col}, x -> x is null or isnan({cell}) or abs({cell}) = double('infinity'))"
    return df.filter(F.col(vector_col).isNotNull()).filter(~F.expr(bad)).select(
        F.col(id_col).cast("bigint").alias(id_col), F.expr(f"transform({vector_col}, x -> floor({factor} * {cell}))").alias("cells")
    )


class Best:
    """The k best candidates of each of some queries, in order: score falling, null ids last, ids rising."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), LOWEST, np.int64)
        self.id = np.zeros((queries, k), np.int64)
        self.null = np.ones((queries, k), bool)
        self.used = np.zeros((queries, k), bool)

    def least(self) -> np.ndarray:
        """Scores that candidates must reach; minus infinity while places are free."""
        return np.where(self.used[:, -1], self.score[:, -1].astype(float), -np.inf)

    def take(self, first: int, query: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """Merge candidates of queries numbered from ``first``."""
        touched = np.unique(query)
        rows = first + touched
        place, _ = np.nonzero(self.used[rows])
        used = self.used[rows]
        query = np.r_[touched[place], query]
        score, ids, null = (
            np.r_[old[rows][used], new] for old, new in ((self.score, score), (self.id, ids), (self.null, null))
        )
        # The order of negated scores, without overflow at the lowest.
        order = np.lexsort((ids, null, ~score, query))
        query = query[order]
        begin = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        rank = np.arange(len(query)) - np.repeat(begin, np.diff(np.r_[begin, len(query)]))
        good = rank < self.k
        at, rank, order = first + query[good], rank[good], order[good]
        self.score[at, rank], self.id[at, rank], self.null[at, rank], self.used[at, rank] = score[order], ids[order], null[order], True


def _survivors(
    asked: np.ndarray, cells: np.ndarray, least: np.ndarray, own: tuple[np.ndarray, np.ndarray], k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of candidates that may be among a query's k best: branch and bound over blocks of dimensions.

    ``asked`` is queries by dimensions, ``cells`` dimensions by candidates, both whole numbers in double precision; ``own`` are
    pairs that do not count.
    """
    order = np.argsort(-(asked**2).sum(axis=0) * (cells**2).sum(axis=1), kind="stable")
    asked, cells = asked[:, order], cells[order]
    size = len(order)
    # Lengths of what remains from each dimension on.
    mass_q = np.sqrt(np.cumsum((asked**2)[:, ::-1], axis=1)[:, ::-1])
    mass_c = np.sqrt(np.cumsum((cells**2)[::-1], axis=0)[::-1])
    bounded = np.isfinite(least).any()
    sums = np.zeros((len(asked), cells.shape[1]))
    column = np.arange(cells.shape[1])
    done = 0
    while done < size:
        step = slice(done, done + STEP)
        sums += asked[:, step] @ cells[step]
        done += STEP
        if not bounded or done >= size:
            continue
        live = sums + SLACK * np.outer(mass_q[:, done], mass_c[done, column]) >= least[:, None]
        if live.mean() < SPARSE:
            query, spot = np.nonzero(live)
            total = sums[live]
            while done < size and len(query):
                step = slice(done, done + STEP)
                total += np.einsum("ij,ji->i", asked[query, step], cells[step, spot])
                done += STEP
                if done < size:
                    rest = SLACK * mass_q[query, done] * mass_c[done, column[spot]]
                    on = total + rest >= least[query]
                    query, spot, total = query[on], spot[on], total[on]
            good = (total >= least[query]) & ~np.isin((query << 32) + column[spot], (own[0] << 32) + own[1])
            return query[good], column[spot[good]], total[good]
        some = live.any(axis=0)
        if 2 * some.sum() < len(some):
            cells, sums, column = np.ascontiguousarray(cells[:, some]), sums[:, some], column[some]
    place = np.searchsorted(column, own[1])
    here = (place < len(column)) & (column[np.minimum(place, len(column) - 1)] == own[1]) if len(column) else np.zeros(len(place), bool)
    sums[own[0][here], place[here]] = -np.inf
    if len(column) > k:
        least = np.maximum(least, np.partition(sums, len(column) - k, axis=1)[:, len(column) - k])
    over, tied = sums > least[:, None], sums == least[:, None]
    # Candidates stand in the order of ties, so the first ones are enough.
    good = (over | (tied & (np.cumsum(tied, axis=1) <= k))) & (sums > -np.inf)
    query, spot = np.nonzero(good)
    return query, column[spot], sums[good]


def _whole_products(
    asked: np.ndarray, cells: np.ndarray, own: tuple[np.ndarray, np.ndarray]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs but ``own`` with 64-bit products, for numbers too large for double precision."""
    sums = asked @ cells
    query, spot = (x.ravel() for x in np.indices(sums.shape))
    good = ~np.isin((query << 32) + spot, (own[0] << 32) + own[1])
    return query[good], spot[good], sums.ravel()[good]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of vectors from rows (row, id, cells): one binary value dimension by dimension, candidates in the order of ties."""
    held: dict[int, list[tuple]] = {}

    def shard(size: int) -> pa.RecordBatch:
        rows, ids, cells = zip(*held.pop(size), strict=True)
        null = np.array([i is None for i in ids])
        ids = np.array([i or 0 for i in ids], np.int64)
        order = np.lexsort((ids, null))
        matrix = np.array(cells, np.int64).reshape(len(ids), size)[order]
        arrays = [matrix.T.astype("<i8"), np.array(rows, "<i8")[order], ids[order].astype("<i8"), null[order]]
        return pa.RecordBatch.from_arrays(
            [pa.array([size]), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in arrays)],
            ["size", "cells", "rows", "ids", "nulls"],
        )

    for batch in batches:
        for row, key, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            some = held.setdefault(len(cells), [])
            some.append((row, key, cells))
            if len(some) == SHARD:
                yield shard(len(cells))
    for size in list(held):
        yield shard(size)


def _shards(folder: str, part: int, parts: int) -> Iterator[dict[str, object]]:
    """Every ``parts``-th of the stored shards, one at a time."""
    there, root = file_system(folder)
    names = sorted(f.path for f in there.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))
    number = 0
    for name in names:
        with there.open_input_file(name) as file:
            for batch in pq.ParquetFile(file).iter_batches(batch_size=1):
                for row in batch.to_pylist():
                    if number % parts == part:
                        yield row
                    number += 1


def _answers(size: int, rows: np.ndarray, asked: np.ndarray, k: int, shards: Iterator[dict[str, object]]) -> Best:
    """The best of a task's queries of one size, from all shards of that size."""
    best = Best(len(rows), k)
    top = float(np.abs(asked.astype(float)).max(initial=0))
    for shard in shards:
        if shard["size"] != size:
            continue
        known, ids = np.frombuffer(shard["rows"], "<i8"), np.frombuffer(shard["ids"], "<i8")
        null = np.frombuffer(shard["nulls"], bool)
        whole = np.frombuffer(shard["cells"], "<i8").reshape(size, len(known))
        cells = whole.astype(float)
        exact = top * float(np.abs(cells).max(initial=0)) * max(size, 1) < EXACT
        order = np.argsort(known)
        for a in range(0, len(rows), BLOCK):
            b = min(a + BLOCK, len(rows))
            at = np.minimum(np.searchsorted(known[order], rows[a:b]), len(known) - 1)
            same = np.flatnonzero(known[order][at] == rows[a:b])
            own = same, order[at[same]]
            if exact:
                query, spot, score = _survivors(asked[a:b].astype(float), cells, best.least()[a:b], own, k)
            else:
                query, spot, score = _whole_products(asked[a:b], whole, own)
            if len(query):
                best.take(a, query, score.astype(np.int64), ids[spot], null[spot])
    return best


def best_products(vectors: DataFrame, asks: Column, k: int, id_col: str = "vec_id") -> DataFrame:
    """(query_id, rank, id, score): for each row of ``vectors`` (id, cells) that ``asks`` selects, the ``k`` other rows with the
    highest inner product, ranked from 1; ties go to the smaller id, null ids last.

    Only vectors of equal length are compared, empty ones among themselves with score 0. Rows that repeat an id are queries
    and candidates of their own; a query leaves out its own row only, so an equal row is a candidate. A null id asks if
    ``asks`` says so. With fewer than ``k`` candidates all are returned, without any or from an empty table none. Products
    beyond 64 bits wrap around.
    """
    spark = vectors.sparkSession
    rows = stored(vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col("cells"), F.coalesce(asks, F.lit(False)).alias("asks")
    ), "vectors")
    total, asking = rows.agg(F.count("*"), F.count_if("asks")).head()
    tasks = shuffle_parts(spark)
    shards = max(1, -(-total // SHARD), min(tasks, -(-total // 512)))
    folder = new_path(spark, "shards")
    dealt = rows.select("row", "id", "cells").repartitionByRange(shards, "row")
    map_batches(dealt, _packed, "size bigint, cells binary, rows binary, ids binary, nulls binary").write.parquet(folder)
    # Few queries meet parts of the shards in several tasks.
    blocks = max(1, -(-asking // HELD))
    parts = min(shards, max(1, tasks // blocks))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple]] = {}

        def answered(part: int, size: int) -> pa.RecordBatch:
            numbers, ids, cells = zip(*held.pop((part, size)), strict=True)
            asked = np.array(cells, np.int64).reshape(len(numbers), size)
            best = _answers(size, np.array(numbers, np.int64), asked, k, _shards(folder, part, parts))
            at, rank = np.nonzero(best.used)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(numbers, np.int64)[at]), pa.array(ids, pa.int64()).take(pa.array(at)),
                    pa.array((rank + 1).astype(np.int32)), pa.array(best.id[at, rank], mask=best.null[at, rank]),
                    pa.array(best.score[at, rank]),
                ],
                ["row", "query_id", "rank", "id", "score"],
            )

        for batch in batches:
            for part, row, key, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                some = held.setdefault((part, len(cells)), [])
                some.append((row, key, cells))
                if len(some) == HELD:
                    yield answered(part, len(cells))
        for part, size in list(held):
            yield answered(part, size)

    queries = rows.filter("asks").select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "row", "id", "cells")
    spread = queries.repartitionByRange(blocks * parts, "part", "row")
    found = map_batches(spread, work, "row bigint, query_id bigint, rank int, id bigint, score bigint")
    if parts > 1:
        ranked = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        found = stored(found, "answers").drop("rank").withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", F.col("id").alias(id_col), "score")

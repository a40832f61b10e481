"""Similarity search over inverted lists: every stored vector is listed under its nearest centroid, and queries meet few lists.

Centroids are learned from a bounded sample; all vectors are listed. The approximate search probes the nearest lists of each query, as
many as an audit against the exact search asks for. The exact search takes the k-th best score found there as a bound and then
visits only the lists that may hold a better one: a vector of a list is at most the list's radius away from its centroid.
Lists and the queries that meet them are cut into blocks, and each pair of blocks is one task of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternlog.operators.ranking import top_rows
from lanternlog.session import ship_package, stored

#: Vectors that centroids are learned from, most lists, and rounds of learning.
SAMPLE, LISTS, ROUNDS = 20_000, 1024, 8
#: Stored vectors and queries that meet in one task.
LIST_BLOCK, QUERY_BLOCK = 16_384, 4096
#: Cosines with centroids that a task holds at once, and queries with a list that it hands on at once.
CELLS, PAIRS = 1_000_000, 8192
#: Queries of the audit, and the recall that it asks for.
AUDIT, RECALL = 200, 0.95


@dataclass(frozen=True)
class Lists:
    """Listed vectors (id, embedding, list) with the centroids of each vector length and the radius of each list in degrees of arc."""

    rows: DataFrame
    centroids: dict[int, np.ndarray]
    radius: dict[int, np.ndarray]
    sizes: dict[int, np.ndarray]
    probes: int = 1


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _steps(rows: int, width: int) -> Iterator[slice]:
    """Slices of ``rows`` rows such that a matrix of a slice with ``width`` columns stays within ``CELLS``."""
    step = max(1, CELLS // max(1, width))
    return (slice(low, low + step) for low in range(0, rows, step))


def _learned(matrix: np.ndarray, wanted: int, seed: int) -> np.ndarray:
    """Spherical k-means of unit vectors, from ``wanted`` different ones; a centroid without members stays where it was."""
    rng = np.random.default_rng(seed)
    different = np.unique(matrix, axis=0)
    centres = different[rng.permutation(len(different))[:wanted]]
    for _ in range(ROUNDS):
        nearest = np.argmax(matrix @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, matrix)
        moved = np.linalg.norm(sums, axis=1) > 0
        centres[moved] = _unit(sums[moved])
    return centres


def build_lists(corpus: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = 7) -> Lists:
    """Lists of all vectors of ``corpus`` (``id``, ``embedding``); about the square root of their number unless ``lists`` is given.

    Null vectors are left out. The driver gets about ``sample`` vectors, picked by a hash of the id, and one row per list.
    """
    ship_package(corpus.sparkSession)
    rows = stored(corpus.select("id", "embedding").where(F.col("embedding").isNotNull()), "vectors")
    total = rows.count()
    scale = 1 << 20
    share = min(scale, max(1, int(scale * sample / max(total, 1))))
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(scale)) < share).select("embedding").limit(2 * sample).toPandas()["embedding"]
    wanted = lists or max(1, min(LISTS, round(total**0.5)))
    centroids = {}
    for size, part in picked.groupby(picked.map(len)):
        if size:
            centroids[int(size)] = _learned(_unit(np.array(part.tolist(), np.float64)), wanted, seed)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            place, away = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            sizes = batch["embedding"].map(len).to_numpy()
            for size in set(sizes.tolist()) & centroids.keys():
                of_size = np.flatnonzero(sizes == size)
                for step in _steps(len(of_size), len(centroids[size])):
                    at = of_size[step]
                    near = _unit(np.array(batch["embedding"].iloc[at].tolist(), np.float64)) @ centroids[size].T
                    place[at] = near.argmax(axis=1)
                    away[at] = np.degrees(np.arccos(np.clip(near.max(axis=1), -1, 1)))
            yield batch.assign(size=sizes.astype("int32"), list=place, away=away)

    schema = T.StructType([*rows.schema.fields, T.StructField("size", T.IntegerType()), T.StructField("list", T.IntegerType()),
                           T.StructField("away", T.DoubleType())])
    table = stored(rows.mapInPandas(listed, schema), "lists")
    radius = {s: np.zeros(len(c)) for s, c in centroids.items()}
    sizes = {s: np.zeros(len(c), np.int64) for s, c in centroids.items()}
    # Vectors of lengths that the sample lacks are one list of their own.
    for row in table.groupBy("size", "list").agg(F.max("away").alias("away"), F.count(F.lit(1)).alias("n")).collect():
        radius.setdefault(row.size, np.zeros(1))[row.list] = row.away
        sizes.setdefault(row.size, np.zeros(1, np.int64))[row.list] = row.n
    return Lists(table.drop("away"), centroids, radius, sizes)


#: From cosines of queries with centroids, the queries and the vectors' length: the lists that each query meets.
Wanted = Callable[[np.ndarray, pd.DataFrame, int], np.ndarray]


def _asked(queries: DataFrame, lists: Lists, wanted: Wanted) -> DataFrame:
    """Queries once for each list they are to meet; ``wanted`` chooses from their cosines with the centroids."""

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["embedding"].map(len).to_numpy()
            for size in sorted(set(sizes.tolist()) & lists_sizes):
                of_size = batch[sizes == size]
                for step in _steps(len(of_size), len(centroids.get(size, [0]))):
                    part = of_size.iloc[step]
                    if size in centroids:
                        near = _unit(np.array(part["embedding"].tolist(), np.float64)) @ centroids[size].T
                        row, place = np.nonzero(wanted(near, part, size))
                    else:
                        row, place = np.arange(len(part)), np.zeros(len(part), int)
                    # A query may meet every list, and each time with its vector.
                    for low in range(0, len(row), PAIRS):
                        some = part.iloc[row[low : low + PAIRS]][["query_id", "embedding"]]
                        yield some.assign(size=np.int32(size), list=place[low : low + PAIRS].astype("int32"))

    centroids, lists_sizes = lists.centroids, set(lists.sizes)
    fields = [f for f in queries.schema.fields if f.name in ("query_id", "embedding")]
    schema = T.StructType([*fields, T.StructField("size", T.IntegerType()), T.StructField("list", T.IntegerType())])
    return queries.mapInPandas(choose, schema)


def _met(asked: DataFrame, lists: Lists, top_k: int, min_score: float, self_match: bool) -> DataFrame:
    """Best rows of each query among the lists it meets."""
    from lanternlog.operators.memory import _partial_search

    asked = stored(asked, "asked")
    blocks = asked.groupBy("size", "list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("blocks"))
    parts = lists.rows.groupBy("size", "list").agg(F.ceil(F.count(F.lit(1)) / LIST_BLOCK).alias("parts"))
    both = stored(blocks.join(parts, ["size", "list"]), "blocks")
    left = asked.join(both, ["size", "list"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    right = lists.rows.join(both, ["size", "list"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    schema = T.StructType([
        T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("id", lists.rows.schema["id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])

    def meet(some: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = list(_partial_search(some, top_k, min_score, self_match)(iter([held])))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "id": [], "score": []})

    keys = ["size", "list", "block", "part"]
    partial = left.select(*keys, "query_id", "embedding").groupBy(*keys).cogroup(
        right.select(*keys, "id", "embedding").groupBy(*keys)
    ).applyInPandas(meet, schema)
    return stored(top_rows(partial, ["query_id"], [F.desc("score"), F.col("id")], top_k), "matches")


def _nearest(probes: int) -> Wanted:
    def wanted(near: np.ndarray, part: pd.DataFrame, size: int) -> np.ndarray:
        order = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        chosen = np.zeros(near.shape, bool)
        np.put_along_axis(chosen, order, True, axis=1)
        return chosen

    return wanted


def search_lists(queries: DataFrame, lists: Lists, top_k: int = 5, min_score: float = 0.2, self_match: bool = True) -> DataFrame:
    """The best matches of each query (``query_id``, ``embedding``) among its ``lists.probes`` nearest lists: may miss some."""
    asking = queries.select("query_id", "embedding").where(F.col("embedding").isNotNull())
    return _met(_asked(asking, lists, _nearest(lists.probes)), lists, top_k, min_score, self_match)


def audited(
    queries: DataFrame, lists: Lists, top_k: int = 5, min_score: float = 0.2, self_match: bool = True, recall: float = RECALL
) -> Lists:
    """``lists`` with as many probes as find the share ``recall`` of what the exact search finds for up to ``AUDIT`` queries."""
    asking = queries.select("query_id", "embedding").where(F.col("embedding").isNotNull())
    some = stored(asking.orderBy(F.xxhash64("query_id")).limit(AUDIT), "audit")
    exact = search_exact(some, lists, top_k, min_score, self_match).select("query_id", "id")
    total = exact.count()
    most = max((len(c) for c in lists.centroids.values()), default=1)
    while lists.probes < most:
        found = search_lists(some, lists, top_k, min_score, self_match).join(exact, ["query_id", "id"]).count()
        if found >= recall * total:
            break
        lists = replace(lists, probes=min(most, 2 * lists.probes))
    return lists


def search_exact(queries: DataFrame, lists: Lists, top_k: int = 5, min_score: float = 0.2, self_match: bool = True) -> DataFrame:
    """The best matches of each query among all vectors, without visiting lists that cannot hold one.

    After a search of the nearest list, a query knows a score that the others must reach. The cosine with a member of a list is at
    most that of the angle to its centroid less the list's radius.
    """
    asking = stored(queries.select("query_id", "embedding").where(F.col("embedding").isNotNull()), "asking")
    first = search_lists(asking, replace(lists, probes=1), top_k, min_score, self_match)
    least = first.where(F.col("rank") == top_k).select("query_id", F.col("score").alias("least"))
    bounded = asking.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float(min_score))))
    radius = lists.radius

    def wanted(near: np.ndarray, part: pd.DataFrame, size: int) -> np.ndarray:
        away = np.degrees(np.arccos(np.clip(near, -1, 1))) - radius[size]
        best = np.cos(np.radians(np.clip(away, 0, 180)))
        # Scores are compared as rounded to four places.
        return best >= part["least"].to_numpy()[:, None] - 1e-4

    return _met(_asked(bounded, lists, wanted), lists, top_k, min_score, self_match)


def compared_pairs(queries: DataFrame, lists: Lists) -> int:
    """Pairs of a query and a stored vector that ``search_lists`` compares."""
    asking = queries.select("query_id", "embedding").where(F.col("embedding").isNotNull())
    met = _asked(asking, lists, _nearest(lists.probes)).groupBy("size", "list").count().collect()
    return sum(int(lists.sizes[r["size"]][r["list"]]) * r["count"] for r in met)

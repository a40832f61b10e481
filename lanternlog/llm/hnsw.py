"""Embedding near-duplicates through hierarchical navigable small-world graphs, one per shard.

Each layer of a graph joins every vector with near but different vectors; a sixteenth of a layer's vectors form the next one.
A search walks down from the smallest layer with a beam of candidates. Vectors are added in blocks, those of the upper layers
first, so that all steps work on arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternlog.llm.common import bounded_batches, components, min_labels, stored

#: Vectors of a shard; neighbours in the lowest and the other layers; beams for building, walking down and searching.
SHARD, LOW, HIGH, BUILD_BEAM, DOWN_BEAM, BEAM = 4096, 32, 16, 64, 16, 64
#: Queries whose true links are counted in each audit, share of them that a search must find, and rows worked on at once.
AUDIT, RECALL, BLOCK = 64, 0.99, 256
#: Beams are widened up to one in so many of a graph's members.
CROWD = 16
#: What 32-bit walking may lose of a cosine; candidates within it are verified in double precision.
SLACK = 1e-4


class Layer:
    """Neighbour lists of the vectors ``0 .. size - 1``, filled up with -1."""

    def __init__(self, vectors: np.ndarray, width: int, neighbours: np.ndarray | None = None):
        self.vectors, self.width, self.size = vectors, width, 0
        self.neighbours = np.full((len(vectors), width), -1, np.int32) if neighbours is None else neighbours
        if neighbours is not None:
            self.size = len(vectors)

    def search(self, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest members that a walk from ``entries`` meets, with cosines, nearest first; -1 where it meets fewer."""
        rows = np.arange(len(queries))[:, None]
        seen = np.zeros((len(queries), self.size + 1), bool)  # the last column stands for -1
        seen[:, -1] = True
        ids = np.full((len(queries), beam), -1, np.int32)
        near = np.full((len(queries), beam), -np.inf, np.float32)
        done = np.ones((len(queries), beam), bool)
        fresh = entries
        live = np.arange(len(queries))
        at_once = max(4, beam // 8)
        while True:
            # Put the fresh members into the beams; repeats within a row come from several parents.
            row = live[:, None]
            fresh = np.sort(fresh, axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
            fresh = np.where(seen[row, fresh], -1, fresh)
            seen[row, fresh] = True
            cosine = np.einsum("qd,qmd->qm", queries[live], self.vectors[fresh], optimize=False).astype(np.float32)
            cosine[fresh < 0] = -np.inf
            all_ids = np.concatenate([ids[live], fresh], axis=1)
            all_near = np.concatenate([near[live], cosine], axis=1)
            all_done = np.concatenate([done[live], fresh < 0], axis=1)
            order = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
            at = np.arange(len(live))[:, None]
            ids[live], near[live], done[live] = all_ids[at, order], all_near[at, order], all_done[at, order]
            live = live[~done[live].all(axis=1)]
            if not len(live):
                return ids, near
            # Open the nearest members that were not opened yet.
            todo = np.argsort(done[live], axis=1, kind="stable")[:, :at_once]
            at = np.arange(len(live))[:, None]
            opened = np.where(done[live][at, todo], -1, ids[live][at, todo])
            done[live[:, None], todo] = True
            fresh = np.where(opened[:, :, None] < 0, -1, self.neighbours[opened]).reshape(len(live), -1)

    def _choose(self, owners: np.ndarray, candidates: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """Neighbours for each owner: candidates nearer to it than to those already taken, then the nearest of the others."""
        order = np.argsort(-cosines, axis=1, kind="stable")
        at = np.arange(len(owners))[:, None]
        candidates, cosines = candidates[at, order], cosines[at, order]
        points = self.vectors[candidates]
        between = points @ points.transpose(0, 2, 1)
        taken = np.zeros(candidates.shape, bool)
        for j in range(candidates.shape[1]):
            nearest = np.where(taken, between[:, j], -np.inf).max(axis=1)
            taken[:, j] = (candidates[:, j] >= 0) & (cosines[:, j] > nearest) & (taken.sum(axis=1) < self.width)
        rank = np.where(taken, 0, np.where(candidates >= 0, 1, 2))
        best = np.argsort(rank, axis=1, kind="stable")[:, : self.width]
        out = np.full((len(owners), self.width), -1, np.int32)
        chosen = candidates[at, best]
        out[:, : chosen.shape[1]] = chosen
        return out

    def add(self, count: int, entries_of) -> None:
        """Add the next ``count`` vectors; ``entries_of`` gives members to start from for their places."""
        new = np.arange(self.size, self.size + count)
        own = self.vectors[new]
        inside = own @ own.T
        np.fill_diagonal(inside, -np.inf)
        top = np.argsort(-inside, axis=1)[:, : min(self.width, count - 1)]
        candidates, cosines = new[top].astype(np.int32), np.take_along_axis(inside, top, axis=1).astype(np.float32)
        if self.size:
            ids, near = self.search(own, entries_of(new), BUILD_BEAM)
            candidates, cosines = np.concatenate([candidates, ids], axis=1), np.concatenate([cosines, near], axis=1)
        self.size += count
        if not candidates.shape[1]:
            return
        self.neighbours[new] = self._choose(new, candidates, cosines)
        # The way back: owners with room take the new neighbours, the others choose again.
        source, target = np.repeat(new, self.width), self.neighbours[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        known = (self.neighbours[target] == source[:, None]).any(axis=1)
        source, target = source[~known], target[~known]
        order = np.lexsort((-np.einsum("ed,ed->e", self.vectors[source], self.vectors[target]), target))
        source, target = source[order], target[order]
        owners, first, sizes = np.unique(target, return_index=True, return_counts=True)
        for a in range(0, len(owners), BLOCK):
            some, begins, n = owners[a : a + BLOCK], first[a : a + BLOCK], np.minimum(sizes[a : a + BLOCK], 2 * self.width)
            extra = np.full((len(some), int(n.max())), -1, np.int32)
            place = np.arange(extra.shape[1])[None, :] < n[:, None]
            extra[place] = source[(begins[:, None] + np.arange(extra.shape[1]))[place]]
            both = np.concatenate([self.neighbours[some], extra], axis=1)
            cosine = np.einsum("qd,qmd->qm", self.vectors[some], self.vectors[both])
            cosine[both < 0] = -np.inf
            self.neighbours[some] = self._choose(some, both, cosine)


class Graph:
    """All layers over unit vectors in order of their layers, the highest first; layer ``i`` holds the first ``sizes[i]``."""

    def __init__(self, vectors: np.ndarray, layers: list[Layer]):
        self.vectors, self.layers = vectors, layers

    @staticmethod
    def sizes(n: int) -> list[int]:
        out = [n]
        while out[-1] > 64:
            out.append(-(-out[-1] // HIGH))
        return out

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        """Graph over unit vectors, which must be in an order that has nothing to do with where they lie."""
        layers: list[Layer] = []
        graph = cls(vectors, layers)
        for i, size in reversed(list(enumerate(cls.sizes(len(vectors))))):
            layer = Layer(vectors[:size], HIGH if i else LOW)
            above = list(layers)
            while layer.size < size:
                # What is already in doubles the block; the upper layers' vectors are in first.
                count = min(size - layer.size, max(64, min(layer.size, BLOCK)))
                layer.add(count, lambda new, above=above, layer=layer: graph._down(above, vectors[new], layer.size))
            layers.append(layer)
        return graph

    def _down(self, layers: list[Layer], queries: np.ndarray, limit: int) -> np.ndarray:
        """Members to start from in the layer below ``layers``, all below ``limit``."""
        first = min(layers[0].size if layers else limit, 64)
        entries = np.tile(np.arange(first, dtype=np.int32), (len(queries), 1))
        for layer in layers:
            entries, _ = layer.search(queries, entries, DOWN_BEAM)
        return np.where(entries < limit, entries, -1)

    def near(self, queries: np.ndarray, least: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, member) of cosine ``least`` or more that searches meet. A beam that is full of such members is widened.

        Walking with a beam of a good part of the graph costs far more than its members' cosines, so a query whose beam is still
        full then is compared with all of them.
        """
        for a in range(0, len(queries), BLOCK):
            todo = np.arange(a, min(a + BLOCK, len(queries)))
            entries = self._down(self.layers[:-1], queries[todo], len(self.vectors))
            width = beam
            while len(todo):
                rows = max(1, BLOCK * BEAM // width)  # wide beams take fewer queries at once
                full = []
                for b in range(0, len(todo), rows):
                    some = todo[b : b + rows]
                    ids, cosine = self.layers[-1].search(queries[some], entries[b : b + rows], width)
                    hit = (ids >= 0) & (cosine >= least)
                    over = hit.all(axis=1) & (width < len(self.vectors))
                    full.append(over)
                    q, j = np.nonzero(hit & ~over[:, None])
                    yield some[q], ids[q, j]
                again = np.concatenate(full)
                todo, entries, width = todo[again], entries[again], min(2 * width, len(self.vectors))
                if CROWD * width > len(self.vectors):
                    yield from self._all_near(queries, todo, least)
                    break

    def _all_near(self, queries: np.ndarray, some: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs as in ``near`` of the queries ``some``, which lie in a crowd, by comparison with every member."""
        for a in range(0, len(some), BLOCK):
            part = some[a : a + BLOCK]
            q, m = np.nonzero(queries[part] @ self.vectors.T >= least)
            yield part[q], m


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten()
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _order(reps: np.ndarray) -> np.ndarray:
    """An order that depends on the ids alone and mixes them."""
    mixed = reps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.lexsort((reps, mixed ^ (mixed >> np.uint64(29))))


def build_shard(table: pa.Table) -> pa.Table:
    """Graph of one shard: its rows in graph order, each with the neighbours of all its layers one after the other."""
    table = table.take(pa.array(_order(np.asarray(table["rep"]))))
    graph = Graph.build(_units(_matrix(table["embedding"])).astype(np.float32))
    lists: list[list[np.ndarray]] = [[] for _ in range(table.num_rows)]
    for layer in graph.layers:
        for i in range(layer.size):
            lists[i].append(layer.neighbours[i])
    neighbours = pa.array([np.concatenate(x) for x in lists], pa.list_(pa.int32()))
    place = pa.array(np.arange(table.num_rows, dtype=np.int32))
    return table.append_column("place", place).append_column("neighbours", neighbours)


def _load(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
    """Representatives, numbers of copies, vectors and graph of a shard."""
    table = table.sort_by("place")
    vectors = _matrix(table["embedding"])
    lists = [np.asarray(x) for x in table["neighbours"].to_pylist()]
    units = _units(vectors).astype(np.float32)
    layers = []
    sizes = Graph.sizes(len(units))
    for i, size in reversed(list(enumerate(sizes))):
        width = HIGH if i else LOW
        begin = [(len(x) - LOW) if not i else len(x) - LOW - i * HIGH for x in lists[:size]]
        own = np.array([x[b : b + width] for x, b in zip(lists, begin, strict=False)], np.int32).reshape(size, width)
        layers.append(Layer(units[:size], width, own))
    return np.asarray(table["rep"]), np.asarray(table["copies"]), vectors, Graph(units, layers)


def find_links(stored_shard: pa.Table, asking: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """(representatives, links of each, smallest representative connected here, links found and true links in the audit).

    ``asking`` may be the shard itself. A number of queries is compared with all vectors of the shard; as long as the search
    misses more of their links than allowed, its beam is doubled. If a beam as wide as the shard misses links, which needs
    a graph in several pieces, the remaining queries are compared with all vectors.
    """
    reps, copies, vectors, graph = _load(stored_shard)
    same = bool(np.asarray(asking["shard"])[0] == np.asarray(stored_shard["shard"])[0])
    if same:
        other, other_copies, queries = reps, copies, vectors
    else:
        other, other_copies, queries = np.asarray(asking["rep"]), np.asarray(asking["copies"]), _matrix(asking["embedding"])
    units = _units(queries).astype(np.float32)
    norms, query_norms = np.linalg.norm(vectors, axis=1), np.linalg.norm(queries, axis=1)
    found = np.zeros((len(queries), len(vectors)), bool)

    def verify(q: np.ndarray, m: np.ndarray) -> np.ndarray:
        cosine = np.einsum("ed,ed->e", queries[q], vectors[m]) / (query_norms[q] * norms[m])
        return (cosine >= least) & ((q != m) if same else True)

    def exact(rows: np.ndarray) -> np.ndarray:
        cosine = (queries[rows] @ vectors.T) / (query_norms[rows, None] * norms[None, :])
        hit = cosine >= least
        if same:
            hit[np.arange(len(rows)), rows] = False
        return hit

    step = max(1, len(queries) // AUDIT)
    audit = np.arange(0, len(queries), step)[:AUDIT]
    truth = exact(audit)
    beam, hits = BEAM, 0
    while True:
        tried = np.zeros(truth.shape, bool)
        for q, m in graph.near(units[audit], least - SLACK, beam):
            good = verify(audit[q], m)
            tried[q[good], m[good]] = True
        hits = int((tried & truth).sum())
        if hits >= RECALL * truth.sum() or beam >= len(vectors):
            break
        beam *= 2
    if hits >= RECALL * truth.sum():
        for q, m in graph.near(units, least - SLACK, beam):
            good = verify(q, m)
            found[q[good], m[good]] = True
    else:
        for a in range(0, len(queries), BLOCK):
            rows = np.arange(a, min(a + BLOCK, len(queries)))
            found[rows] = exact(rows)
    if same:
        found |= found.T
    names = reps if same else np.concatenate([other, reps])
    shift = 0 if same else len(other)
    order = np.argsort(names, kind="stable")  # labels are places in ascending order of representatives
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    label = np.arange(len(names))
    for a in range(0, len(queries), BLOCK):
        q, m = np.nonzero(found[a : a + BLOCK])
        label = min_labels(label[place[q + a]], label[place[m + shift]], len(names))[label]
    links = found @ copies.astype(np.int64)
    if not same:
        links = np.concatenate([links, found.T @ other_copies.astype(np.int64)])
    some = np.flatnonzero(links > 0)
    return names[some], links[some], names[order][label[place[some]]], hits, int(truth.sum())


def link_near(
    df: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    shard: int = SHARD,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: vectors of equal label are linked at cosine ``least`` or more.

    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id reachable, and ``kept`` says that it
    is the row's own. Rows with a null id, label or vector, and vectors that are empty, zero, or hold null or non-finite
    components link with nothing; their component is their own id. Vectors of different lengths are not linked. Equal vectors
    are one member with a number of copies, so they are linked however many there are. Rows that repeat an id count
    as rows of their own.

    Labels are cut into shards of about ``shard`` members by a hash of the id. Every shard's graph is built once and stored;
    every shard is searched with the members of itself and of the later shards of its label.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).alias("label"))
    sound = (
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("embedding", lambda x: x != 0)
    )
    rows = stored(rows.withColumn("sound", F.coalesce(sound, F.lit(False))), "vectors")
    classes = rows.filter("sound").groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = stored(classes.withColumn("size", F.size("embedding")), "classes")
    counts = stored(
        classes.groupBy("label", "size").count().select("label", "size", F.ceil(F.col("count") / shard).cast("int").alias("shards")), "counts"
    )
    placed = classes.join(counts, ["label", "size"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
    placed = placed.select("label", "size", "shards", "shard", "rep", "copies", "embedding")
    kind = f"label {df.schema[label_col].dataType.simpleString()}, size int"
    built = stored(
        placed.groupBy("label", "size", "shard").applyInArrow(
            build_shard, f"{kind}, shards int, shard int, rep bigint, copies bigint, embedding array<double>, place int, neighbours array<int>"
        ), "graphs",
    )
    keys = ["label", "size", "stored", "asking"]
    index = built.withColumn("stored", F.col("shard")).withColumn("asking", F.explode(F.sequence("shard", F.col("shards") - 1)))
    asking = built.drop("neighbours").withColumn("asking", F.col("shard")).withColumn("stored", F.explode(F.sequence(F.lit(0), "shard")))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            empty = pa.array([], pa.int64())
            return pa.table([empty] * 3, names=["rep", "n", "root"])
        reps, links, roots, _, _ = find_links(left, right, least)
        return pa.table([pa.array(reps), pa.array(links), pa.array(roots)], names=["rep", "n", "root"])

    linked = stored(
        index.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(search, "rep bigint, n bigint, root bigint"), "links"
    )
    sums = linked.groupBy("rep").agg(F.sum("n").alias("n"))
    whole = components(linked, "rep", "root")
    found = stored(
        classes.join(sums, "rep", "left").join(whole, classes.rep == whole.node, "left").select(
            "label", "embedding", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"), F.lit(True).alias("sound"),
        ), "members",
    )
    out = rows.join(found, ["label", "embedding", "sound"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )

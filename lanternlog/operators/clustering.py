"""Templates by clustering of similar signatures (Drain: He et al., ICWS 2017).

Signatures of one scope, length and leading words are a leaf. A leaf of any size is cut into pieces of at most ``PIECE`` signatures in
the order of their texts. A piece is clustered in the order of first sight, with an index of tokens by position: to share enough
positions with a cluster, a signature must meet it in one of its rarest positions, so only clusters found there are compared. The
templates of a leaf's pieces are then merged: in one more piece if they fit, else by an index of their rarest positions on
Spark, whose postings are cut into blocks as well. So no task grows with an application, and nothing similar stays apart.

Masked rows are stored in parts, each with whole leaves, and mined a few parts at a time. What a round stores or shuffles is deleted
when it ends, so beside the rows and the mined rows only a share of the texts is on disk at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternlog.functions.ids import template_id
from lanternlog.functions.masks import with_masks
from lanternlog.operators.ranking import lookup_join, numbered
from lanternlog.session import delete, folder_sizes, new_path, scratch, ship_package, stored, write_compact

WILDCARD = "<*>"
#: Signatures or templates that are clustered together in one task.
PIECE = 4096
#: Parts that masked rows are stored in, and bytes of them that are mined in one round, but one part at least.
PARTS, ROUND_BYTES = 16, 64 << 20
#: Signatures of a round that may go to all tasks; texts of more are not even measured.
BROADCAST_ROUND = 50_000
_SCOPE = ("application", "environment")
#: Where a template belongs, for those that are clustered further.
_PLACE = ("leaf", "node", "first_seen")


def _with_leaf(patterns: DataFrame, depth: int, pattern: str = "pattern") -> DataFrame:
    """Add the leaf a pattern belongs to: its scope, length and leading tokens, those with digits as wildcards."""
    whole = F.col(pattern)
    text = F.btrim(F.when(whole.contains("  "), F.regexp_replace(whole, " +", " ")).otherwise(whole), F.lit(" "))
    blanks = F.length("_text") - F.length(F.replace("_text", F.lit(" "), F.lit("")))
    tokens = F.when(F.col("_text") == "", 0).otherwise(blanks + 1)
    lead = F.regexp_replace(F.substring_index("_text", " ", max(depth - 3, 0)), "[^ ]*[0-9][^ ]*", WILDCARD)
    leaf = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in _SCOPE], tokens.cast("string"), lead)
    return patterns.withColumn("_text", text).withColumn("leaf", leaf).drop("_text")


class _Clusters:
    """Clusters of one piece, found through the tokens at their positions. Tokens are numbers, 0 is the wildcard."""

    def __init__(self, width: int, similarity: float):
        import numpy as np

        self.similarity, self.width, self.used = similarity, width, 0
        self.held = np.zeros((64, width), dtype=np.int32)
        self.at: dict[tuple[int, int], list[int]] = {}
        self.same: dict[bytes, int] = {}

    def find(self, row) -> int:
        """The cluster with most equal tokens, then most wildcards, then the oldest, if it is similar enough; else -1."""
        import numpy as np

        equal_text = self.same.get(row.tobytes(), -1)
        need = max(1, int(np.ceil(self.similarity * self.width - 1e-9)))
        lists = sorted((self.at.get((p, c), ()) for p, c in enumerate(row.tolist()) if c), key=len)
        # A cluster that shares enough positions is missing from fewer than all of the shortest lists.
        few = [x for x in lists[: max(len(lists) - need + 1, 0)] if x]
        if not few:
            return equal_text
        near = np.unique(np.concatenate(few))
        held = self.held[near]
        equal = ((held == row) & (held != 0)).sum(axis=1)
        best = int(np.argmax(equal * (self.width + 1) + (held == 0).sum(axis=1)))
        return int(near[best]) if equal[best] >= need else equal_text

    def add(self, row) -> int:
        import numpy as np

        if self.used == len(self.held):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        self.held[self.used] = row
        for p, c in enumerate(row.tolist()):
            if c:
                self.at.setdefault((p, c), []).append(self.used)
        self.same.setdefault(row.tobytes(), self.used)
        self.used += 1
        return self.used - 1

    def widen(self, cluster: int, row) -> None:
        """Turn the tokens in which ``row`` differs into wildcards; places where they were listed are compared in vain."""
        held = self.held[cluster]
        if (held != row).any() and ((held != row) & (held != 0)).any():
            if self.same.get(held.tobytes()) == cluster:
                del self.same[held.tobytes()]
            held[held != row] = 0
            self.same.setdefault(held.tobytes(), cluster)


def _cluster_texts(patterns: list[str], known: list[str | None], similarity: float) -> tuple[list[str], list[str | None]]:
    """For each pattern of a piece, in order, the text of its cluster and the known id of it."""
    import numpy as np

    if len(patterns) == 1:
        return [" ".join(w for w in patterns[0].split(" ") if w)], known
    codes = {WILDCARD: 0}
    rows = [np.array([codes.setdefault(w, len(codes)) for w in pattern.split(" ") if w], dtype=np.int32) for pattern in patterns]
    clusters = _Clusters(len(rows[0]), similarity)
    ids: list[str | None] = []
    member = []
    for row, known_id in zip(rows, known):
        chosen = clusters.find(row) if known_id is None else -1
        if chosen < 0:
            chosen = clusters.add(row)
            ids.append(known_id)
        else:
            clusters.widen(chosen, row)
        member.append(chosen)
    names = {code: word for word, code in codes.items()}
    texts = [" ".join(names[code] for code in cluster) for cluster in clusters.held[: clusters.used].tolist()]
    return [texts[i] for i in member], [ids[i] for i in member]


def _cluster_piece(piece: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Add to each pattern of a piece, in order, the text of its cluster and the known id of it."""
    merged, ids = _cluster_texts(piece["pattern"].tolist(), piece["known"].tolist(), similarity)
    return piece.assign(merged=merged, template_id=ids)


def _by_piece(similarity: float, carry: Sequence[str] = _PLACE) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Function over batches sorted by ``group`` that clusters each group by itself; ``carry`` names the columns it hands on.

    Most groups of texts are a single row, so the groups of a batch are cut from lists, and one frame is made of all.
    """

    def clustered(rows: pd.DataFrame, starts: list[int]) -> pd.DataFrame:
        patterns, known = rows["pattern"].tolist(), rows["known"].tolist()
        merged, ids = [], []
        for low, high in zip(starts, [*starts[1:], len(rows)]):
            texts, of = _cluster_texts(patterns[low:high], known[low:high], similarity)
            merged += texts
            ids += of
        return rows[[*carry]].assign(merged=merged, template_id=ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd

        # The rows of the last group so far, which may go on in the next batch.
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            if held and held[-1]["group"].iat[-1] == batch["group"].iat[-1]:
                held.append(batch)
                continue
            rows = pd.concat([*held, batch], ignore_index=True)
            keys = rows["group"].to_numpy()
            starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()]
            if starts[-1]:
                yield clustered(rows.iloc[: starts[-1]], starts[:-1])
            held = [rows.iloc[starts[-1] :]]
        if held:
            yield clustered(pd.concat(held), [0])

    return run


def _link_posting(rows: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """For each template of a posting that has no known id: the most similar of those before it, if similar enough."""
    import numpy as np

    codes = {WILDCARD: 0}
    held = np.array([[codes.setdefault(w, len(codes)) for w in text.split(" ")] for text in rows["pattern"]], dtype=np.int32)
    width = held.shape[1]
    need = max(1, int(np.ceil(similarity * width - 1e-9)))
    known = rows["known"].notna().to_numpy()
    child, parent, shared, wild = [], [], [], []
    for i in np.flatnonzero(~known[1:]) + 1:
        before = held[:i]
        equal = ((before == held[i]) & (before != 0)).sum(axis=1)
        loose = (before == 0).sum(axis=1)
        best = int(np.argmax(equal * (width + 1) + loose))
        if equal[best] >= need and rows["node"].iat[best] != rows["node"].iat[i]:
            child.append(i), parent.append(best), shared.append(equal[best]), wild.append(loose[best])
    nodes = rows["node"].to_numpy()
    return pd.DataFrame({"node": nodes[child], "parent": nodes[parent], "equal": np.array(shared, "int64"), "wild": np.array(wild, "int64")})


def _by_group(work: Callable[[pd.DataFrame], pd.DataFrame], key: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Function over batches sorted by ``key`` that applies ``work`` to the rows of one key at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd

        held: list[pd.DataFrame] = []
        group = None
        for batch in batches:
            if not len(batch):
                continue
            keys = batch[key].to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
            done = []
            for low, high in zip(cuts[:-1], cuts[1:]):
                if held and keys[low] != group:
                    done.append(work(pd.concat(held) if len(held) > 1 else held[0]))
                    held = []
                group = keys[low]
                held.append(batch.iloc[low:high])
            if done:
                yield pd.concat(done)
        if held:
            yield work(pd.concat(held))

    return run


_NODE = "sha2(concat_ws('\x1f', leaf, merged, coalesce(template_id, '')), 256)"
_ORDER = ("first", "first_seen", "pattern", "known")


def _clustered(items: DataFrame, similarity: float, carry: Sequence[str] = _PLACE) -> DataFrame:
    """Columns ``carry``, merged, template_id of items (leaf, piece, node, pattern, first_seen, known), clustered piece by piece."""
    ship_package(items.sparkSession)
    read = list(dict.fromkeys(["pattern", "known", *carry]))
    group = F.concat_ws("\x1f", "leaf", F.col("piece").cast("string"))
    keyed = items.withColumn("group", group).withColumn("late", F.col("known").isNotNull())
    # Groups in the order of their hashes, which are compared faster than texts with a long common start.
    ordered = keyed.select("group", "late", *dict.fromkeys([*read, "first_seen"])).repartition("group").sortWithinPartitions(
        F.xxhash64("group"), "group", F.desc("late"), "first_seen", "pattern", "known"
    )
    kinds = [f"{c} {'timestamp' if c == 'first_seen' else 'string'}" for c in carry]
    schema = ", ".join([*kinds, "merged string, template_id string"])
    return stored(ordered.select("group", *read).mapInPandas(_by_piece(similarity, carry), schema), "clustered")


def _links(nodes: DataFrame, similarity: float) -> DataFrame:
    """(node, parent): the most similar earlier template of each one that has any, in leaves of any number of templates.

    A template is listed at its rarest positions, as many as it needs to meet all that share enough of them. Long postings are cut into
    slots, and pairs of slots are compared by tasks of their own; each hands on one link per member.
    """
    words = nodes.withColumn("words", F.split("pattern", " ")).withColumn("width", F.size("words"))
    spots = words.select("leaf", "node", "width", F.posexplode("words").alias("pos", "word")).where(F.col("word") != WILDCARD)
    often = spots.groupBy("leaf", "pos", "word").agg(F.count(F.lit(1)).alias("often"))
    lists = spots.join(often, ["leaf", "pos", "word"]).groupBy("leaf", "node", "width").agg(
        F.array_sort(F.collect_list(F.struct("often", "pos", "word"))).alias("spots")
    )
    need = F.greatest(F.ceil(F.col("width") * similarity - 1e-9), F.lit(1))
    rarest = F.slice("spots", F.lit(1), F.greatest(F.size("spots") - need + 1, F.lit(0)).cast("int"))
    slots = F.ceil(F.col("spot.often") / PIECE)
    own = F.pmod(F.xxhash64("node"), slots)
    listed = (
        lists.select("leaf", "node", F.explode(rarest).alias("spot")).where("spot.often > 1")
        .withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), slots - 1)))
    )
    posting = F.concat_ws(
        "\x1f", "leaf", "spot.pos", "spot.word", F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string")
    )
    members = listed.select(posting.alias("posting"), "node").join(nodes, "node").withColumn("first", F.col("known").isNull())
    ordered = members.select("posting", "node", *_ORDER).repartition("posting").sortWithinPartitions("posting", *_ORDER)
    work = lambda rows: _link_posting(rows, similarity)
    found = ordered.mapInPandas(_by_group(work, "posting"), "node string, parent string, equal long, wild long")
    earlier = nodes.select(F.col("node").alias("parent"), *[F.col(c).alias(f"p_{c}") for c in ("first_seen", "pattern", "known")])
    ranked = found.join(earlier, "parent").groupBy("node").agg(F.min(F.struct(
        (-F.col("equal")).alias("less"), (-F.col("wild")).alias("tighter"), F.col("p_known").isNull().alias("first"),
        "p_first_seen", "p_pattern", "p_known", "parent",
    )).alias("best"))
    return stored(ranked.select("node", "best.parent", "best.less"), "links")


def _merge_linked(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, merged, template_id) of templates that change: each root takes its best child and all that fit the result.

    Roots have no link to an earlier template. Children that do not fit, and those of templates that are children
    themselves, wait for the next round, where the first of them are roots.
    """
    roots = links.join(links.select(F.col("node").alias("parent")), "parent", "left_anti")
    pairs = roots.join(nodes, "node").join(nodes.select(
        F.col("node").alias("parent"), F.col("pattern").alias("root_pattern"), F.col("known").alias("root_known")
    ), "parent")
    split = lambda c: F.split(c, " ")
    joined = F.array_join(F.zip_with(split("root_pattern"), split("pattern"), lambda a, b: F.when(a == b, a).otherwise(WILDCARD)), " ")
    best = pairs.withColumn("joined", joined).groupBy("parent").agg(
        F.min(F.struct("less", "first_seen", "pattern", "joined")).alias("one")
    ).select("parent", F.col("one.joined").alias("merged"))
    with_best = stored(pairs.join(best, "parent"), "merging")
    fits = F.forall(F.zip_with(split("merged"), split("pattern"), lambda m, c: (m == WILDCARD) | (m == c)), lambda ok: ok)
    children = with_best.where(fits).select("node", "merged", F.col("root_known").alias("template_id"))
    return children.unionByName(
        with_best.select(F.col("parent").alias("node"), "merged", F.col("root_known").alias("template_id")).distinct()
    )


def _nodes(mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``mapping`` (item, leaf, first_seen, merged, template_id) with the node of each item, and the nodes.

    Templates of equal text are one; if earlier runs know the text, it takes the smallest of their ids.
    """
    ids = mapping.groupBy("leaf", "merged").agg(F.min("template_id").alias("_id"))
    keyed = mapping.join(ids, ["leaf", "merged"]).withColumn("template_id", F.coalesce("template_id", "_id")).drop("_id")
    keyed = stored(keyed.withColumn("node", F.expr(_NODE)), "mapping")
    nodes = keyed.groupBy("leaf", "node").agg(
        F.min("merged").alias("pattern"), F.min("template_id").alias("known"), F.min("first_seen").alias("first_seen")
    )
    return keyed, stored(nodes, "templates")


def _merge_pieces(mapping: DataFrame, similarity: float) -> DataFrame:
    """Items (item, leaf, first_seen, merged, template_id) of leaves that were cut, with the templates of whole leaves."""
    done = None
    while True:
        mapping, nodes = _nodes(mapping)
        sizes = nodes.groupBy("leaf").agg(F.count(F.lit(1)).alias("_templates"))
        sized = nodes.join(sizes, "leaf")
        fitting = sized.where(F.col("_templates") <= PIECE).drop("_templates").withColumn("piece", F.lit(0))
        last = _clustered(fitting, similarity).select("node", F.col("merged").alias("_text"), F.col("template_id").alias("_id"))
        settled = mapping.join(last, "node").select("item", "leaf", "first_seen", F.col("_text").alias("merged"), F.col("_id").alias("template_id"))
        done = settled if done is None else done.unionByName(settled)
        large = stored(sized.where(F.col("_templates") > PIECE).drop("_templates"), "large")
        links = _links(large, similarity)
        moved = _merge_linked(large, links).select("node", F.col("merged").alias("_text"), F.col("template_id").alias("_id"))
        moving = links.join(large.select("node", "leaf"), "node").select("leaf").distinct()
        left = mapping.join(large.select("leaf").distinct(), "leaf", "left_semi")
        done = done.unionByName(left.join(moving, "leaf", "left_anti").drop("node"))
        if links.isEmpty():
            return done
        mapping = left.join(moving, "leaf", "left_semi").join(moved, "node", "left").select(
            "item", "leaf", "first_seen", F.coalesce("_text", "merged").alias("merged"),
            F.when(F.col("_text").isNotNull(), F.col("_id")).otherwise(F.col("template_id")).alias("template_id"),
        )


def cluster_signatures(
    signatures: DataFrame,
    similarity: float = 0.5,
    depth: int = 4,
    known: DataFrame | None = None,
    carry: Sequence[str] = (*_SCOPE, "template_text"),
) -> DataFrame:
    """Template of every distinct signature (``application``, ``environment``, ``template_text``, ``first_seen``).

    The templates of earlier runs, ``known``, are clusters from the start: a signature that fits one gets its ``template_id``, also
    where it widens the pattern. ``template_id`` is null for templates that are new. ``carry`` names the texts of the signatures
    that stand beside ``mined_text`` and ``template_id``.

    ``depth`` routes signatures by their first ``depth - 3`` words at every size of the input; leaves above ``PIECE`` signatures
    are cut in the order of their texts. A leaf within that size is clustered as one, in the order of first sight. The result
    depends on the signatures alone, not on partitions.
    """
    rest = [c for c in carry if c not in _SCOPE]
    patterns = signatures.select(
        *_SCOPE, F.col("template_text").alias("pattern"), "first_seen", F.lit(None).cast("string").alias("known"), *rest
    )
    if known is not None:
        patterns = patterns.unionByName(
            known.select(*_SCOPE, F.col("template_pattern").alias("pattern"), "first_seen", F.col("id").alias("known")),
            allowMissingColumns=True,
        )
    keyed = _with_leaf(patterns, depth).select("leaf", "pattern", "first_seen", "known", *carry)
    items = stored(keyed.withColumn("node", F.monotonically_increasing_id().cast("string")), "signatures")
    sizes = stored(items.groupBy("leaf").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > PIECE).select("leaf"), "leaf-sizes")
    cut = not sizes.isEmpty()
    if cut:
        placed = numbered(items.join(sizes, "leaf", "left_semi"), ["leaf"], ["pattern", "known", "first_seen"])
        large = placed.withColumn("piece", F.floor(F.col("number") / PIECE)).drop("number")
        pieces = items.join(sizes, "leaf", "left_anti").withColumn("piece", F.lit(0).cast("bigint")).unionByName(large)
    else:
        pieces = items.withColumn("piece", F.lit(0))
    result = ["known", *carry, "merged", "template_id"]
    merged = _clustered(pieces, similarity, [*(_PLACE if cut else ()), "known", *carry])
    if cut:
        parts = merged.join(sizes, "leaf", "left_semi")
        whole = _merge_pieces(parts.select(F.col("node").alias("item"), "leaf", "first_seen", "merged", "template_id"), similarity)
        joined = parts.drop("merged", "template_id").join(whole.withColumnRenamed("item", "node").drop("leaf", "first_seen"), "node")
        merged = stored(merged.join(sizes, "leaf", "left_anti").select(*result).unionByName(joined.select(*result)), "merged")
    return merged.where(F.col("known").isNull()).select(*carry, F.col("merged").alias("mined_text"), "template_id")


def _rounds(sizes: dict[str, int]) -> list[list[str]]:
    """Folders of parts in groups of at most ``ROUND_BYTES``, or of a single part that is larger; one group without folders."""
    rounds: list[list[str]] = [[]]
    filled = 0
    for name, size in sorted(sizes.items()):
        if rounds[-1] and filled + size > ROUND_BYTES:
            rounds.append([])
            filled = 0
        rounds[-1].append(name)
        filled += size
    return rounds


def mine_templates(
    events: DataFrame,
    message: str = "sanitized_message",
    similarity: float = 0.5,
    depth: int = 4,
    known: DataFrame | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``template_text`` and ``template_id`` by clustering the masked first lines.

    Pass the dictionary of earlier runs (template contract) as ``known``, so that templates keep their ids. ``keep`` names the
    columns of the events that the caller reads, beside the scope; without it all are stored and returned.

    Rows are first reduced to distinct signatures; only those are clustered, and the result is joined back, in rounds over parts
    of the masked rows. Rows without a scope or text have no template and go.
    """
    spark = events.sparkSession
    others = [c for c in (events.columns if keep is None else keep) if c not in (*_SCOPE, "template_text", "template_id")]
    masked = with_masks(events, message, "template_text").select(*dict.fromkeys([*_SCOPE, "template_text", "event_ts", *others]))
    part = F.pmod(F.xxhash64("leaf"), F.lit(PARTS)).cast("int").alias("_part")
    target = new_path(spark, "mined")
    with scratch(spark):
        path = new_path(spark, "masked")
        write_compact(_with_leaf(masked, depth, "template_text").select(*masked.columns, part), path, by="_part")
        if known is not None:
            scoped = known.select(*_SCOPE, "id", "template_pattern", "first_seen")
            known = stored(_with_leaf(scoped, depth, "template_pattern").select(*scoped.columns, part), "known")
        for folders in _rounds(folder_sizes(spark, path)):
            at = [f"{path}/{name}" for name in folders]
            rows = spark.read.schema(masked.schema).parquet(*(at or [path])).select("*", F.col("_metadata.row_index").alias("_at"))
            before = None if known is None else known.where(F.col("_part").isin([int(name.partition("=")[2]) for name in folders]))
            with scratch(spark):
                result = _mined(rows, similarity, depth, before).select(*_SCOPE, *others, "template_text", "template_id")
                write_compact(result, target, "append")
            for name in at:
                delete(spark, name)
    return spark.read.schema(result.schema).parquet(target)


def _mined(rows: DataFrame, similarity: float, depth: int, known: DataFrame | None) -> DataFrame:
    """Masked rows with the template of each."""
    rows = rows.where(F.col("application").isNotNull() & F.col("environment").isNotNull() & F.col("template_text").isNotNull())
    named = [part for c in _SCOPE for part in (F.length(F.col(c).cast("string")).cast("string"), F.col(c).cast("string"))]
    key = F.sha2(F.concat_ws("\x1f", *named, "template_text"), 256)
    signatures = rows.groupBy(*_SCOPE, "template_text").agg(
        F.min("event_ts").alias("first_seen"), F.count(F.lit(1)).cast("string").alias("_rows")
    ).withColumn("_key", key)
    own = template_id(F.col("mined_text"), F.col("application"), F.col("environment"))
    mapping = cluster_signatures(signatures, similarity, depth, known, ["_key", "_rows", *_SCOPE]).select(
        "_key", F.col("mined_text").alias("template_text"), F.coalesce("template_id", own).alias("template_id"),
        F.col("_rows").cast("bigint").alias("_rows"),
    )
    return lookup_join(rows.withColumn("_key", key).drop("template_text"), mapping, ["_key"], "_rows", ["_at"], BROADCAST_ROUND, held=True)


def widened_templates(mined: DataFrame, known: DataFrame) -> DataFrame:
    """Alias rows: known templates whose pattern a run has widened, with the old and the new pattern."""
    now = mined.groupBy(F.col("template_id").alias("id")).agg(F.min("template_text").alias("template_pattern"))
    before = known.select("id", F.col("template_pattern").alias("earlier_pattern"))
    return before.join(now, "id").where(F.col("earlier_pattern") != F.col("template_pattern"))

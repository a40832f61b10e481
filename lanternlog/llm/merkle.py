"""Merkle manifest of a table: a tree for each group, and one over the groups' roots, held as concatenated levels.

An aligned block of 1,024 nodes keeps every level as one string of 64-digit digests. Parents are hashes of fixed-width
substrings, siblings are the substrings beside a node, and the roots of the blocks are the nodes of the next tier, where the same
step starts again. Everything is a DataFrame expression: no task holds more than one block at a time and a tier is a thousandth
of the one below, so the largest group of any size costs one more tier at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternlog.llm.common import shuffle_parts, stored

#: Nodes of a block are two to this power.
HEIGHT = 10
HEX = 64


def leaf_digest(columns: Sequence[Column | str]) -> Column:
    """SHA-256 of the values, one after the other: ``-`` if null, else the number of UTF-8 bytes, ``:`` and the value."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _levels(node: str, height: Column) -> Column:
    """All levels of a block, from the string of its nodes up to ``height`` levels of parents."""
    parents = (
        f"cast(array_join(transform(sequence(0, (octet_length(l) - 1) div {2 * HEX}), "
        f"i -> sha2(substring(l, {2 * HEX} * i + 1, {2 * HEX}), 256)), '') as binary)"
    )
    grow = f"aggregate(sequence(1, height), array({node}), (done, k) -> concat(done, transform(slice(done, -1, 1), l -> {parents})))"
    return F.when(height > 0, F.expr(grow)).otherwise(F.array(node))


def _flanks(levels: str, place: str) -> str:
    """What stands left and right of a node's ancestors, level by level: left, right, left, right, ...; empty if nothing does."""
    at = f"shiftright({place}, k)"
    level = f"element_at({levels}, k + 1)"
    return (
        f"flatten(transform(slice(sequence(0, {HEIGHT}), 1, size({levels}) - 1), k -> array("
        f"if({at} % 2 = 1, cast(substring({level}, {HEX} * ({at} - 1) + 1, {HEX}) as string), ''), "
        f"if({at} % 2 = 0, cast(substring({level}, {HEX} * ({at} + 1) + 1, {HEX}) as string), ''))))"
    )


def _ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, their number from 0 inside their group in the order of ``order``.

    Rows are dealt out by ranges of group and order, so a group of any size is many tasks; a range's first number is a prefix sum
    over one row per range and group.
    """
    keys = [group, *order]
    # Equal rows are told apart, so that any number of them can be dealt out.
    dealt = rows.withColumn("_copy", F.monotonically_increasing_id()).repartitionByRange(
        shuffle_parts(rows.sparkSession), *keys, "_copy"
    ).sortWithinPartitions(*keys, "_copy").drop("_copy")
    placed = dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    placed = stored(placed, "ranked")
    counts = placed.groupBy(group, "_part").agg(F.count("*").alias("n"), F.min("_at").alias("_low"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        F.col(group).alias("_group"), F.col("_part").alias("_range"), "_low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base")
    )
    return placed.join(
        bases, placed[group].eqNullSafe(bases._group) & (placed._part == bases._range)
    ).withColumn("pos", F.col("_at") - F.col("_low") + F.col("_base")).drop("_group", "_range", "_low", "_base", "_at", "_part")


def _blocks(nodes: DataFrame, group: str, payload: Sequence[str] = ()) -> DataFrame:
    """(group, block, many, levels, kept): blocks of nodes in their order with all their levels; ``kept`` has each node with its payload.

    ``many`` tells that the group has more blocks, so that the block is a part of a larger tree and gets all its levels.
    """
    placed = nodes.withColumn("_block", F.shiftright("pos", HEIGHT))
    packed = placed.groupBy(group, "_block").agg(
        F.array_sort(F.collect_list(F.struct("pos", "node", *payload))).alias("_nodes")
    )
    last = packed.groupBy(F.col(group).alias("_group")).agg(F.max("_block").alias("_last"))
    joined = packed.join(last, packed[group].eqNullSafe(last._group)).drop("_group")
    alone = F.ceil(F.log2(F.size("_nodes").cast("double"))).cast("int")
    sized = joined.withColumn("height", F.when(F.col("_last") > 0, HEIGHT).otherwise(alone))
    strings = sized.withColumn("_string", F.expr("cast(array_join(transform(_nodes, n -> n.node), '') as binary)"))
    return stored(
        strings.select(
            group, F.col("_block").alias("block"), (F.col("_last") > 0).alias("many"), _levels("_string", F.col("height")).alias("levels"),
            F.expr(f"transform(_nodes, n -> struct({', '.join(f'n.{p} as {p}' for p in ('pos', 'node', *payload))}))").alias("kept"),
        ), "merkle-blocks",
    )


def _roots(blocks: DataFrame, group: str) -> DataFrame:
    return blocks.select(group, "many", F.col("block").alias("pos"), F.expr("cast(element_at(levels, -1) as string)").alias("node"))


def _tree(nodes: DataFrame, group: str, payload: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of blocks of every group, and (group, node) with the groups' roots."""
    tiers = [_blocks(nodes, group, payload)]
    roots = _roots(tiers[0], group).filter("not many")
    while True:
        upper = _roots(tiers[-1], group).filter("many")
        if upper.isEmpty():
            return tiers, roots.select(group, "node")
        tiers.append(_blocks(upper.drop("many"), group))
        roots = roots.unionByName(_roots(tiers[-1], group).filter("not many"))


def _paths(tiers: list[DataFrame], group: str, finished: DataFrame) -> DataFrame:
    """(group, columns of ``finished``, kept columns, path) of all nodes of the lowest tier.

    ``finished`` has for every group the ``_end`` of its paths, above its root. Blocks are joined with what stands above them, so a
    join moves one row a block; nodes are taken apart after it.
    """
    path = f"concat({_flanks('levels', f'n.pos % {1 << HEIGHT}')}, if(many, _upper, _end))"
    more = [c for c in finished.columns if c not in (group, "_end")]
    ends = finished.withColumnRenamed(group, "_whole")
    above = None
    for blocks in reversed(tiers):
        ready = blocks.join(ends, blocks[group].eqNullSafe(ends._whole)).drop("_whole")
        if above is None:
            ready = ready.withColumn("_upper", F.col("_end"))
        else:
            upper = above.select(F.col(group).alias("_group"), F.col("pos").alias("_pos"), F.col("path").alias("_upper"))
            match = ready[group].eqNullSafe(upper._group) & (ready.block == upper._pos) & ready.many
            ready = ready.join(upper, match, "left").drop("_group", "_pos")
        made = ready.select(group, *more, F.explode(F.expr(f"transform(kept, n -> struct(n as kept, {path} as path))")).alias("_one"))
        above = made.select(group, *more, "_one.kept.*", "_one.path")
    return above


def fold(node: str, path: str) -> str:
    """SQL for the root that a node and the flanks of its ancestors give."""
    return (
        f"if(size({path}) = 0, {node}, aggregate(sequence(0, greatest(size({path}) div 2 - 1, 0)), {node}, "
        f"(h, i) -> sha2(concat({path}[2 * i], h, {path}[2 * i + 1]), 256)))"
    )


def manifest(df: DataFrame, leaf: Column, group: str = "lang", order: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """(group, order, carried columns, leaf, subroot, root, path) of every row.

    ``leaf`` is a row's digest. In every group, leaves ascend by ``order`` (null first; rows that repeat it by leaf), and while
    more than one node remains, every two neighbours become the digest of both and a last single one the digest of itself.
    What remains is the group's ``subroot``; subroots in the order of their groups (null first, by bytes) likewise give ``root``.
    ``path`` holds what stands left and right of the row's ancestors, from the leaf to the root, as digests or empty strings:
    joined together it is the proof, and ``fold`` gives the root it leads to. ``carry`` names further columns to take along.

    Null texts, groups and ids are values of their own; equal rows are equal leaves, each with its place; only the named columns are
    read, so others may have any name. A single row is its own root with an empty path; an empty table gives no rows.
    """
    carry = carry or {}
    extra = [f"_c{i}" for i in range(len(carry))]
    leaves = df.select(
        F.col(group).alias("grp"), F.col(order).alias("ord"), leaf.alias("node"), *(c.alias(x) for c, x in zip(carry.values(), extra, strict=True))
    )
    ranked = _ranked(stored(leaves, "leaves"), "grp", ["ord", "node"])
    tiers, subroots = _tree(ranked, "grp", ["ord", *extra])
    # The tree over the groups: one group, in which the groups are the leaves.
    top = _ranked(stored(subroots, "subroots").withColumn("whole", F.lit(0)), "whole", ["grp"])
    over, roots = _tree(top, "whole", ["grp"])
    ends = roots.select("whole", F.col("node").alias("root"), F.expr("cast(array() as array<string>)").alias("_end"))
    groups = _paths(over, "whole", ends).select("grp", F.col("node").alias("subroot"), "root", F.col("path").alias("_end"))
    return _paths(tiers, "grp", stored(groups, "group-roots")).select(
        F.col("grp").alias(group), F.col("ord").alias(order), *(F.col(x).alias(c) for c, x in zip(carry, extra, strict=True)),
        F.col("node").alias("leaf"), "subroot", "root", "path",
    )

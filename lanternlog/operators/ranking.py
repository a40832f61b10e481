"""Positions, first rows and lookups for groups that may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternlog.session import materialize, stored

# A slot with more rows than this is cut again before it is sorted.
HOT_SLOT_ROWS = 1_000_000
# At most this many keys can each hold more than one in this many of all rows: the bound of a list of hot keys.
HOT_KEYS = 10_000
# Tables of more rows or bytes than this are not sent to every task.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def small_table(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether a table is small enough to be sent to every task, by its rows and by the bytes of its values as text."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))
    count, total = df.agg(F.count(F.lit(1)), size).first()
    return count <= rows and (total or 0) <= most


def exact_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slot: Column,
    fine: Sequence[Column] = (),
    rank: str = "rank",
    hot_rows: int = HOT_SLOT_ROWS,
) -> DataFrame:
    """1-based position of each row in its key group, without sorting a whole group in one task.

    ``slot`` must not decrease along ``order``. Slots are counted with a partial aggregate, the counts are
    summed up per group, and only the rows of one slot are sorted together. A slot above ``hot_rows`` is
    cut by ``fine``, columns that are a leading part of ``order``; the rows of such a slot are told apart
    before they are shuffled, so they never meet in one task.
    """
    cut = df.withColumn("_slot", slot)
    by_slot = [*keys, "_slot"]
    counted = materialize(cut.groupBy(*by_slot).agg(F.count(F.lit(1)).alias("_rows")))
    earlier = W.partitionBy(*keys).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    places = counted.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    total = counted.agg(F.sum("_rows")).first()[0] or 0
    limit = max(hot_rows, total // HOT_KEYS)
    hot = counted.where(F.col("_rows") > limit).select(*by_slot, F.lit(True).alias("_hot"))
    together = by_slot
    if fine and hot.head(1):
        # Not more than HOT_KEYS slots can be above the limit, but their keys may be long.
        cut = cut.join(F.broadcast(hot) if small_table(hot) else hot, by_slot, "left")
        cut = cut.withColumn("_part", F.when(F.col("_hot"), F.struct(*fine))).drop("_hot")
        cut = cut.withColumn("_part_key", F.coalesce(F.to_json("_part"), F.lit("")))
        together = [*by_slot, "_part_key"]
        earlier_parts = W.partitionBy(*by_slot).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        parts = (
            cut.groupBy(*together, "_part")
            .agg(F.count(F.lit(1)).alias("_part_rows"))
            .withColumn("_part_before", F.coalesce(F.sum("_part_rows").over(earlier_parts), F.lit(0)))
        )
        places = parts.join(places, by_slot).select(
            *together, (F.col("_before") + F.col("_part_before")).alias("_before")
        )
    placed = cut.join(places, together)
    inside = F.row_number().over(W.partitionBy(*together).orderBy(*order))
    helpers = ("_slot", "_rows", "_before", "_part", "_part_key")
    return placed.withColumn(rank, (F.col("_before") + inside).cast("bigint")).drop(*helpers)


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    rows: str,
    spread_by: Sequence[str],
    broadcast_rows: int = BROADCAST_ROWS,
    hot_keys: int = HOT_KEYS,
    held: bool = False,
) -> DataFrame:
    """Add the columns of the one row each key has in ``small``; its column ``rows`` counts the rows of the key.

    A table of few rows and bytes goes to all tasks. Otherwise both sides are shuffled, and the rows of a key above one in
    ``hot_keys`` of all rows are dealt out over copies of its small row. A table that is ``held`` in files is read from them.
    """
    small = small if held else materialize(small)
    if (not held or small.count() <= broadcast_rows) and small_table(small.drop(rows), broadcast_rows):
        return big.join(F.broadcast(small.drop(rows)), list(keys))
    share = max(1, (small.agg(F.sum(rows)).first()[0] or 0) // hot_keys)
    copies = F.ceil(F.col(rows) / share).cast("int")
    hot = small.where(F.col(rows) > share).select(*keys, copies.alias("_copies"))
    dealt = F.pmod(F.xxhash64(*spread_by), F.col("_copies")).cast("int")
    salted = big.join(F.broadcast(hot) if small_table(hot) else hot, list(keys), "left").withColumn("_salt", F.coalesce(dealt, F.lit(0)))
    numbers = F.sequence(F.lit(0), F.greatest(F.when(F.col(rows) > share, copies), F.lit(1)) - 1)
    copied = small.withColumn("_salt", F.explode(numbers)).drop(rows)
    return salted.drop("_copies").join(copied, [*keys, "_salt"]).drop("_salt")


def first_rows(
    df: DataFrame, keys: Sequence[str], lead: str, order: Sequence[str], broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """First row of each key group under ``order``, whose leading column ``lead`` is a number or time.

    With few groups the minimum of ``lead`` is a fixed-width hash aggregate that is sent to all tasks, and only
    the rows that tie on it are looked at. With many groups each task folds its rows before the shuffle.
    """
    keys = list(keys)
    best = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    lows = materialize(df.groupBy(*keys).agg(F.min(lead).alias("_low")))
    if small_table(lows, broadcast_rows):
        df = df.join(F.broadcast(lows), keys).where(F.col(lead) == F.col("_low")).drop("_low")
    return df.groupBy(*keys).agg(best).select("_row.*")


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark cuts each map task to ``k`` rows before the shuffle."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "number") -> DataFrame:
    """Add the 0-based place of each row in its key group; ``order`` must tell apart rows that are not equal.

    Rows are dealt out by ranges of the keys and ``order``, so no task holds a group of any size; the place of a range's first row is
    a prefix sum over one row per range and group. The rows are stored, so a range stays what it was if an executor is lost.
    """
    keys = list(keys)
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    placed = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_range", F.shiftright("_at", 33))
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    bases = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_low")).select(
        *keys, "_range", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_low")).alias("_base")
    )
    return placed.join(bases, [*keys, "_range"]).withColumn(name, F.col("_at") + F.col("_base")).drop("_at", "_range", "_base")

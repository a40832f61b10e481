"""Shared steps of the operators: bounded Arrow batches, stored tables, ragged arrays, connected components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternlog.session import new_path, ship_package

#: Rows of an Arrow batch, and bytes of text that are worked on at once inside one.
BATCH_ROWS, SLICE_BYTES = 1000, 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold few rows, since single texts may be very long, and let workers import the package."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with bounded batches."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(work, schema)


def slices(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about SLICE_BYTES of text; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        sizes = np.zeros(batch.num_rows, np.int64) if not column.nbytes else np.asarray(
            pc.fill_null(pc.binary_length(column), 0), np.int64
        )
        parts = np.cumsum(sizes) // SLICE_BYTES
        cuts = np.flatnonzero(np.diff(parts)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: int = 1) -> list[str]:
    """The texts of a slice; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, so that a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs ``starts[i] .. starts[i] + lengths[i]``, one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    """0 and the running totals of ``lengths``."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def shuffle_parts(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def min_labels(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Smallest index reachable from each of ``size`` nodes over the links ``a[i] - b[i]``, inside one task."""
    label = np.arange(size)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            break
    return label


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has a link.

    Each round sends every link to the smallest labels of its ends and points nodes at the label of their label. Labels are a
    table with one row per node, so a node's label is found by a join of two written tables, which Spark splits where a
    label is hot; minima are summed up before the shuffle. The number of rounds grows with the logarithm of the longest chain.
    Null ends are ignored. Without links the result is empty.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    pairs = stored(ends.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), "links")
    kind = pairs.schema["u"].dataType.simpleString()
    both = pairs.select(F.col("u").alias("node"), F.col("v").alias("seen")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("u").alias("seen"))
    )
    labels = stored(both.groupBy("node").agg(F.least("node", F.min("seen")).alias("label")), "labels")
    live = pairs
    while True:
        # What each label points at now, in one step of shortcutting.
        jumped = stored(
            labels.alias("l").join(labels.alias("p"), F.col("l.label") == F.col("p.node"))
            .select(F.col("l.node").alias("node"), F.col("p.label").alias("label")), "labels",
        )
        # Links between the labels; those inside one label are settled.
        half = live.join(jumped, live.u == jumped.node).select(F.col("label").alias("u"), "v")
        live = stored(
            half.join(jumped, half.v == jumped.node).select(F.col("u"), F.col("label").alias("v"))
            .filter("u <> v").distinct(), "links",
        )
        if live.isEmpty():
            if jumped.join(labels, "node").filter(jumped.label != labels.label).isEmpty():
                return jumped.select("node", F.col("label").cast(kind).alias("component"))
            labels = jumped
            continue
        seen = live.select(F.col("u").alias("root"), F.col("v").alias("to")).unionByName(
            live.select(F.col("v").alias("root"), F.col("u").alias("to"))
        ).groupBy("root").agg(F.least("root", F.min("to")).alias("low"))
        labels = stored(
            jumped.join(stored(seen, "lows"), F.col("label") == F.col("root"), "left")
            .select("node", F.least("label", F.coalesce("low", "label")).alias("label")), "labels",
        )


def kth_largest(df: DataFrame, key: str, k: int, few: int = 10_000) -> float | None:
    """The k-th largest value of a numeric column: counts in 1,000 bins, again and again in the bin that holds it."""
    bounds = df.agg(F.min(key), F.max(key), F.count(key)).head()
    low, high, n = bounds[0], bounds[1], bounds[2]
    if not 1 <= k <= n:
        return low if n and k > n else None
    above, inside = 0, n
    while inside > few and high > low:
        step = (high - low) / 1000
        if not step or low + step == low:
            break
        rows = (
            df.filter(F.col(key).between(low, high))
            .groupBy(F.least(F.floor((F.col(key) - low) / step), F.lit(999)).alias("bin"))
            .agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        )
        for row in sorted(rows, key=lambda r: -r.bin):
            if above + row.n >= k:
                break
            above += row.n
        if row.n == inside and (row.low, row.high) == (low, high):
            break
        low, high, inside = row.low, row.high, row.n
    if high == low:
        return low
    values = df.filter(F.col(key).between(low, high)).groupBy(key).count().orderBy(F.desc(key)).limit(few).collect()
    for value, n in values:
        above += n
        if above >= k:
            return value
    return values[-1][0] if values else None


def gumbel(u: float) -> float:
    return -math.log(-math.log(u))

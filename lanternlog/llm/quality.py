"""Quality by importance resampling: how much likelier a text's hashed n-grams are among good texts than in the raw corpus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from zlib import crc32

from lanternlog.llm.common import kth_largest, map_batches, offsets_of, slices, stored
from lanternlog.llm.known import Known, Runs, cut_at_white, text_bytes

#: Buckets of hashed n-grams, and about how many labelled texts of each kind are learned from.
BUCKETS, SAMPLE = 1 << 15, 20_000
TWICE = np.uint64(1)  # stands for a word that follows itself
TOKENS = regex.compile(r"\w+|[^\w\s]+")


class Features(Known):
    """Texts as buckets of their words and pairs of neighbouring words; all pairs of a word with itself share a bucket."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        super().forget()
        self.hashes = Runs(np.uint64)

    def learn(self, parts: list[bytes]) -> None:
        found = [[crc32(t.encode()) for t in TOKENS.findall(p.decode().lower())] for p in parts]
        n = np.fromiter(map(len, found), np.int64, len(found))
        self.hashes.extend(np.fromiter((h for row in found for h in row), np.uint64, int(n.sum())), n)

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all texts one after the other, and where each text's begin."""
        data, bounds = text_bytes(column)
        starts, ends, counts = cut_at_white(data, bounds, [])
        at = self.number(data, starts, ends)
        begins = offsets_of(self.hashes.lengths(at))[offsets_of(counts)]
        words = self.hashes.take(at)
        text = np.repeat(np.arange(len(counts)), np.diff(begins))
        inner = np.flatnonzero(text[1:] == text[:-1])
        pairs = words[inner] * np.uint64(0x9E3779B97F4A7C15) + words[inner + 1]
        pairs[words[inner] == words[inner + 1]] = TWICE
        every = np.concatenate([words, pairs]) * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(np.concatenate([text, text[inner]]), kind="stable")
        sizes = np.diff(begins)
        return (every >> np.uint64(49)).astype(np.int64)[order], offsets_of(sizes + np.maximum(sizes - 1, 0))


@lru_cache(1)
def features() -> Features:
    return Features()


@dataclass
class Model:
    """Log ratio of the two generative models for each bucket, and the mean below which a text is rejected."""

    ratio: np.ndarray
    cutoff: float = -np.inf

    def weigh(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of features and log importance weight of each text."""
        buckets, begins = features().of(column)
        return np.diff(begins), np.diff(np.concatenate([[0.0], np.cumsum(self.ratio[buckets])])[begins])


def _mean(n: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return weight / np.maximum(n, 1)


def _sample(labels: DataFrame, id_col: str, condition: str, sample: int) -> np.ndarray:
    """About ``sample`` ids of labelled rows, picked by a hash."""
    rows = labels.filter(condition).filter(f"`{id_col}` is not null").select(F.col(id_col).cast("bigint").alias("id")).distinct()
    n, scale = rows.count(), 1 << 30
    if n > sample:
        rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(scale)) < int(scale * sample / n))
    return np.array(sorted(r.id for r in rows.collect()), np.int64)


def learn_model(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good: str = "quality = 1 and toxic = 0",
    bad: str = "quality = 0", sample: int = SAMPLE,
) -> Model:
    """The model of good texts against that of all texts.

    Good texts are about ``sample`` labelled ones at most; the raw model counts every text of ``df``. The cutoff is fitted on
    about ``sample`` labelled texts of each kind: where fewest are on the wrong side, a good one counting as ten bad ones;
    ties go to the middle of the gap. Without labelled texts of both kinds nothing is rejected but texts without words.
    """
    chosen, refused = (_sample(labels, id_col, x, sample) for x in (good, bad))
    rows = df.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in slices(batches):
            buckets, begins = features().of(batch.column(1))
            raw += np.bincount(buckets, minlength=BUCKETS)
            mine = np.isin(np.asarray(batch.column(0).fill_null(-1)), chosen)
            target += np.bincount(buckets[np.repeat(mine, np.diff(begins))], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    counted = map_batches(rows, count, "bucket bigint, raw bigint, target bigint")
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for row in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[row.bucket] += row.raw
        target[row.bucket] += row.target
    if not len(chosen):
        return Model(np.zeros(BUCKETS))
    model = Model(np.log(target / target.sum()) - np.log(raw / raw.sum()))
    if not len(refused):
        return model
    found = [(r.mean, r.good) for r in _scored(rows, model, chosen, refused).collect()]  # a row for each sampled id at most
    model.cutoff = _cut(found)
    return model


def _scored(rows: DataFrame, model: Model, chosen: np.ndarray, refused: np.ndarray) -> DataFrame:
    """(_id, mean, good) of the sampled ids whose texts have words; of an id with several texts, the lowest mean."""
    wanted = np.union1d(chosen, refused)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column(0).fill_null(-1)
            mine = pa.array(np.isin(np.asarray(ids), wanted))
            n, weight = model.weigh(batch.column(1).filter(mine))
            ids = np.asarray(ids.filter(mine))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[n > 0]), pa.array(_mean(n, weight)[n > 0]), pa.array(np.isin(ids, chosen)[n > 0])], ["_id", "mean", "good"]
            )

    scored = map_batches(rows, score, "_id bigint, mean double, good boolean")
    return scored.groupBy("_id").agg(F.min("mean").alias("mean"), F.first("good").alias("good"))


def _cut(scored: list[tuple[float, bool]]) -> float:
    """Value below which to reject: a lost good text counts as ten kept bad ones."""
    values = np.array([x for x, _ in scored])
    good = np.array([x for _, x in scored], bool)
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(values, kind="stable")
    values, good = values[order], good[order]
    loss = np.concatenate([[0], np.cumsum(np.where(good, 10 * max(1.0, (~good).sum() / good.sum()), -1.0))])
    loss[1:-1][values[1:] == values[:-1]] = np.inf  # equal values stay together
    best = np.flatnonzero(loss == loss.min())
    i = int(best[len(best) // 2])
    if i == 0:
        return -np.inf
    return float((values[i - 1] + values[min(i, len(values) - 1)]) / 2)


def weigh(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, log_weight, log_ratio, rejected) of every whole text, one row per input row.

    ``log_weight`` sums the log ratios of a text's words and word pairs, ``log_ratio`` is their mean. Rejected are texts whose
    mean lies below the cutoff, and texts without words (null, empty, blank), whose weights are 0.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, weight = model.weigh(batch.column(1))
            mean = _mean(n, weight)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(weight), pa.array(mean), pa.array((n == 0) | (mean < model.cutoff))],
                [id_col, "n_features", "log_weight", "log_ratio", "rejected"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_features bigint, log_weight double, log_ratio double, rejected boolean"
    return map_batches(df.select(id_col, text_col), work, schema)


def resample(weighed: DataFrame, share: float = 0.5, seed: int = 7, id_col: str = "doc_id") -> DataFrame:
    """``weighed`` with ``sample_key`` and ``selected``: Gumbel top-k, a draw without replacement by importance weight.

    A row's key is its log weight plus Gumbel noise from a hash of its id, so a repeated run draws the same. Of the rows that
    are not rejected the ``share`` with the largest keys (rounded down, at least one) is selected; rows with equal keys go
    together. The bound is found by counting, without sorting or gathering rows.
    """
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    keyed = stored(weighed.withColumn("sample_key", F.col("log_weight") - F.log(-F.log(u))), "weighed")
    left = keyed.filter(~F.col("rejected"))
    n = left.count()
    bound = kth_largest(left, "sample_key", max(1, int(share * n))) if n else None
    picked = F.lit(False) if bound is None else ~F.col("rejected") & (F.col("sample_key") >= F.lit(bound))
    return keyed.withColumn("selected", picked)


def keep_good(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the model does not reject, with all their columns; nothing is shuffled.

    This is the draw of ``resample`` with room for every text that is not rejected: no good text is left to chance.
    """
    place = df.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place):
            n, weight = model.weigh(batch.column(place))
            yield batch.filter(pa.array((n > 0) & (_mean(n, weight) >= model.cutoff)))

    return map_batches(df, work, df.schema)

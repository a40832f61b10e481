"""Language identification by rank-order profiles.

A language's profile is its most frequent character n-grams in order. A text's own most frequent n-grams are compared with each
profile: every n-gram costs how far out of place it stands, or the profile's size where the profile lacks it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternlog.llm.common import map_batches, slices, texts_of

#: n-grams of a profile, n-grams of a text, and about how many labelled texts of a language a profile is learned from.
PROFILE, OWN, SAMPLE = 400, 300, 2000
UNDETERMINED = "und"
#: Texts are judged among those with as many different n-grams, in these steps; a step needs ENOUGH labelled texts to have a bound, which
#: is MARGIN times the lowest score that any of them has in its own language.
STEPS, ENOUGH, MARGIN = (8, 16, 32, 64, 128, 256), 50, 0.8


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of 1 to 3 characters and their counts. What is no letter separates words and counts as one mark."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.where(letter, codes, 1)
    codes = np.concatenate([[1], codes, [1]])
    codes = codes[np.r_[True, (codes[1:] != 1) | (codes[:-1] != 1)]]
    one, two = codes[codes != 1], codes[:-1] << 21 | codes[1:]
    three = two[:-1] << 21 | codes[2:]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


@dataclass
class Profiles:
    """Languages in order, all n-grams of their profiles in order, and the rank of each in each (the size if lacking)."""

    names: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int
    bounds: tuple[float, ...] = (0.0,) * (len(STEPS) + 1)

    def predict(self, text: str) -> tuple[str, float]:
        """Nearest language and how near: 1 less the share of the largest possible distance. Ties go to the first name."""
        return self.nearest(text)[:2]

    def knows(self, text: str) -> bool:
        """Whether the text is about as near to a language as texts of its length are to their own."""
        name, score, step = self.nearest(text)
        return name != UNDETERMINED and score >= self.bounds[step]

    def nearest(self, text: str) -> tuple[str, float, int]:
        """The prediction, and the step that the text's number of n-grams belongs to."""
        own, counts = grams(text)
        if not len(own) or not self.names:
            return UNDETERMINED, 0.0, 0
        top = own[np.argsort(-counts, kind="stable")[:OWN]]
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        ranks = np.where(self.grams[at] == top, self.ranks[:, at], self.size)
        apart = np.minimum(np.abs(ranks - np.arange(len(top))), self.size)
        apart[ranks == self.size] = self.size
        total = apart.sum(axis=1)
        best = int(np.argmin(total))
        return self.names[best], 1.0 - float(total[best]) / (self.size * len(top)), bisect_right(STEPS, len(top))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from: a third of all, by a checksum of the id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _learning_rows(df: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int) -> DataFrame:
    """(_id, _text, _lang) of labelled rows that are not held out, about ``sample`` of each language."""
    labelled = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).filter(
        F.col("_lang").isNotNull() & F.col("_text").isNotNull()
    )
    labelled = labelled.filter(~held_out("_id"))
    rows = labelled.groupBy("_lang").count().collect()
    scale = 1 << 20
    crowded = [(r["_lang"], int(scale * sample / r["count"])) for r in rows if r["count"] > sample]
    if crowded:
        share = F.create_map(*[F.lit(x) for pair in crowded for x in pair])
        labelled = labelled.filter(
            F.pmod(F.xxhash64("_id"), F.lit(scale)) < F.coalesce(F.try_element_at(share, F.col("_lang")), F.lit(scale))
        )
    return labelled


def learn_profiles(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE,
    size: int = PROFILE,
) -> Profiles:
    """Profiles of all languages in ``lang_col``, from rows that are not held out.

    A language with more rows is learned from about ``sample`` of them, picked by a hash of the id; counts are added up in
    each task before they are shuffled. The driver gets ``size`` n-grams of each language.
    """
    labelled = _learning_rows(df, id_col, text_col, lang_col, sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in slices(batches, 0):
            found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for text, lang in zip(texts_of(batch, 0), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, [totals[lang]] if lang in totals else []).append(grams(text))
            for lang, parts in found.items():
                keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                totals[lang] = keys, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)
        for lang, (keys, counts) in totals.items():
            for a in range(0, len(keys), 10_000):
                some = keys[a : a + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(counts[a : a + 10_000])],
                    ["lang", "gram", "n"],
                )

    counted = map_batches(labelled.select("_text", F.col("_lang").cast("string").alias("_lang")), count, "lang string, gram bigint, n bigint")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = summed.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < size).select("lang", "gram", "rank").collect()
    names = sorted({r["lang"] for r in top})
    every = np.array(sorted({r["gram"] for r in top}), np.int64)
    ranks = np.full((len(names), len(every)), size, np.int64)
    for r in top:
        ranks[names.index(r["lang"]), np.searchsorted(every, r["gram"])] = r["rank"]
    return Profiles(names, every, ranks, size)


def learn_bounds(
    df: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE,
) -> Profiles:
    """The same profiles with bounds on the score for ``knows``, from labelled rows that are not held out.

    About ``sample`` rows of each language are scored, picked by a hash of the id; the driver gets one row per step. Steps with
    fewer than ENOUGH texts of a rightly predicted language have no bound, so nothing is rejected there.
    """
    labelled = _learning_rows(df, id_col, text_col, lang_col, sample)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            found = [profiles.nearest(t) for t in texts_of(batch, 0)]
            right = [f[0] == lang for f, lang in zip(found, batch.column(1).to_pylist(), strict=True)]
            columns = [pa.array([f[i] for f, r in zip(found, right, strict=True) if r], t) for i, t in ((1, pa.float64()), (2, pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["score", "step"])

    scored = map_batches(labelled.select("_text", F.col("_lang").cast("string").alias("_lang")), score, "score double, step int")
    low = {r.step: MARGIN * r.low for r in scored.groupBy("step").agg(F.min("score").alias("low"), F.count("*").alias("n")).collect() if r.n >= ENOUGH}
    return replace(profiles, bounds=tuple(low.get(i, 0.0) for i in range(len(STEPS) + 1)))


def predict(df: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) of every whole text, one row per input row.

    ``lang_pred`` is ``und`` with score 0 if the text is null or has no letter, or if nothing was learned. Ids may be null or
    repeated; further columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [profiles.predict(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                [id_col, "held_out", "lang_pred", "score"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    chosen = df.select(F.col(id_col), F.col(text_col), held_out(id_col).alias("held_out"))
    return map_batches(chosen, work, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def keep_known(df: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text has a known language: not ``und``, and not below the bound of ``learn_bounds``.

    Rows pass through unchanged with all their columns, and nothing is shuffled. Without bounds only ``und`` goes.
    """
    place = df.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place):
            yield batch.filter(pa.array([profiles.knows(t) for t in texts_of(batch, place)], pa.bool_()))

    return map_batches(df, work, df.schema)

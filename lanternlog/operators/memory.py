"""Incident memory: embeddings, exact similarity search and the records it searches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternlog.functions.binding import bind
from lanternlog.functions.ids import row_id
from lanternlog.functions.vectors import DIMENSIONS, norm, token_bucket
from lanternlog.operators.ranking import small_table, top_rows
from lanternlog.schemas import EMBEDDINGS, conform
from lanternlog.session import materialize

# Queries that are sent to every task at once; more queries meet inverted lists.
QUERY_BLOCK = 4_096
# Scores that a task holds at once.
SCORE_CELLS = 1_000_000
# Marks of a resolution record and of the notes inside it.
RESOLUTION_MARK = "[Resolution Knowledge"
NOTES_MARK = "Resolution Notes & Steps:"
# Actions whose comment is worth remembering.
REMEMBERED_ACTIONS = ("resolved", "resolve", "dismiss")


def embed_text(
    texts: DataFrame, keys: Sequence[str], text: str, dimensions: int = DIMENSIONS, target: str = "embedding"
) -> DataFrame:
    """Unit vector of hashed token counts of each row. A text without tokens gets the zero vector.

    A narrow expression: no row is shuffled, and a long text is read once and then stands for its token numbers only.
    """
    tokens = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda token: token != "")
    places = F.sequence(F.lit(0), F.lit(dimensions - 1))

    def counts(buckets: Column) -> Column:
        return F.transform(places, lambda place: (F.size(buckets) - F.size(F.array_remove(buckets, place))).cast("double"))

    def unit(vector: Column) -> Column:
        return bind(norm(vector), lambda length: F.transform(vector, lambda x: F.when(length > 0, x / length).otherwise(F.lit(0.0))))

    hashed = F.transform(tokens, lambda token: token_bucket(token, dimensions))
    vector = bind(bind(hashed, counts), unit)
    return texts.select(*keys, vector.cast("array<float>").alias(target))


def _partial_search(queries: pd.DataFrame, top_k: int, min_score: float, self_match: bool, cells: int = SCORE_CELLS):
    """Function from stored vectors (columns id, embedding) to the best rows for each query of a block.

    No more than about ``cells`` scores are held at once, and of these only the best of each query become rows.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd

        if not len(queries):
            return
        sizes = queries["embedding"].map(len)
        groups = []
        for size, part in queries.groupby(sizes):
            matrix = np.array(part["embedding"].tolist(), dtype=np.float64)
            lengths = np.linalg.norm(matrix, axis=1)
            groups.append((int(size), part["query_id"].reset_index(drop=True), matrix, lengths))
        best: dict[int, pd.DataFrame] = {}
        # The score that a row must reach, once its query has ``top_k`` matches.
        floors = [np.full(len(names), -np.inf) for _, names, _, _ in groups]
        for batch in batches:
            batch = batch[batch["embedding"].notna()]
            batch_sizes = batch["embedding"].map(len)
            for number, (size, names, matrix, lengths) in enumerate(groups):
                same = batch[batch_sizes == size]
                step = max(1, cells // max(1, len(names)))
                for low in range(0, len(same), step):
                    part = same.iloc[low : low + step]
                    stored = np.array(part["embedding"].tolist(), dtype=np.float64)
                    both = np.outer(lengths, np.linalg.norm(stored, axis=1))
                    scores = matrix @ stored.T
                    np.divide(scores, both, out=scores, where=both > 0)
                    scores[~(both > 0)] = 0.0
                    unfit = ~(scores >= min_score)
                    if not self_match:
                        codes, _ = pd.factorize(pd.concat([names, part["id"]], ignore_index=True))
                        own = codes[: len(names), None]
                        unfit |= (own == codes[None, len(names) :]) & (own >= 0)
                    np.round(scores, 4, out=scores)
                    scores[unfit] = -np.inf
                    least = floors[number]
                    if scores.shape[1] > top_k:
                        least = np.maximum(least, np.partition(scores, -top_k, axis=1)[:, -top_k])
                    # The best of each query, ties included.
                    rows, columns = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
                    if not len(rows):
                        continue
                    found = pd.DataFrame(
                        {
                            "query_id": names.to_numpy()[rows],
                            "id": part["id"].to_numpy()[columns],
                            "score": scores[rows, columns],
                        }
                    )
                    if number in best:
                        found = pd.concat([best[number], found])
                    found = found.sort_values(["query_id", "score", "id"], ascending=[True, False, True])
                    best[number] = found.groupby("query_id", sort=False).head(top_k)
                    held = best[number].groupby("query_id")["score"].agg(["size", "min"])
                    full = held.loc[held["size"] >= top_k, "min"]
                    floors[number] = names.map(full).fillna(-np.inf).to_numpy(np.float64)
        for found in best.values():
            yield found

    return search


def search_similar(
    queries: DataFrame,
    corpus: DataFrame,
    top_k: int = 5,
    min_score: float = 0.2,
    self_match: bool = True,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The ``top_k`` stored vectors with the highest cosine per query, at least ``min_score``.

    ``queries`` has ``query_id`` and ``embedding``, ``corpus`` has ``id`` and ``embedding``. Exact: every
    vector is scored, but a task hands on only its best ``top_k`` rows per query. Up to ``query_block``
    queries of bounded size go to all tasks, so the corpus is not shuffled. Beyond that the corpus is listed by centroids,
    and queries meet only lists that may hold a match (``vector_lists``).
    """
    wanted = materialize(queries.select("query_id", "embedding").where(F.col("embedding").isNotNull()))
    stored = corpus.select("id", "embedding")
    schema = T.StructType(
        [
            T.StructField("query_id", wanted.schema["query_id"].dataType),
            T.StructField("id", stored.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    if not small_table(wanted, query_block):
        from lanternlog.operators.vector_lists import build_lists, search_exact

        return search_exact(wanted, build_lists(stored), top_k, min_score, self_match)
    partial = stored.mapInPandas(_partial_search(wanted.toPandas(), top_k, min_score, self_match), schema)
    return top_rows(partial, ["query_id"], [F.desc("score"), F.col("id")], top_k)


def search_resolutions(
    queries: DataFrame, corpus: DataFrame, top_k: int = 3, min_score: float = 0.25, overfetch: int = 2
) -> DataFrame:
    """Resolution records among the best ``overfetch * top_k`` matches; ``corpus`` also has ``text_content``."""
    return resolutions_among(search_similar(queries, corpus, top_k * overfetch, min_score), corpus, top_k)


def resolutions_among(matches: DataFrame, corpus: DataFrame, top_k: int = 3) -> DataFrame:
    """The best ``top_k`` resolution records among the matches of a search."""
    matches = matches.drop("rank")
    texts = corpus.select("id", "text_content").where(F.col("text_content").contains(RESOLUTION_MARK))
    return top_rows(matches.join(texts, "id"), ["query_id"], [F.desc("score"), F.col("id")], top_k)


def search_similar_approx(
    queries: DataFrame, corpus: DataFrame, top_k: int = 5, min_score: float = 0.2, self_match: bool = True, recall: float = 0.95
) -> DataFrame:
    """Like ``search_similar``, comparing each query with the nearest lists only; an audit sets how many, for ``recall``."""
    from lanternlog.operators.vector_lists import audited, build_lists, search_lists

    lists = audited(queries, build_lists(corpus), top_k, min_score, self_match, recall)
    return search_lists(queries, lists, top_k, min_score, self_match)


def _records(rows: DataFrame, created: Column) -> DataFrame:
    """Rows with anomaly, template and text to rows of the embedding contract."""
    named = rows.withColumn("id", row_id(F.col("anomaly_id"), F.col("text_content"))).withColumn("created_at", created)
    return conform(embed_text(named, named.columns, "text_content"), EMBEDDINGS)


def index_records(anomalies: DataFrame, analyses: DataFrame) -> DataFrame:
    """Memory records of triaged anomalies: application, template and summary of each verdict."""
    verdicts = analyses.select("anomaly_id", "summary", F.col("created_at").alias("_at"))
    subject = anomalies.select(F.col("id").alias("anomaly_id"), "application", "template_id", "template_text")
    text = F.concat(
        F.lit("["), F.col("application"), F.lit("] "), F.col("template_text"), F.lit(" :: "), F.col("summary")
    )
    return _records(verdicts.join(subject, "anomaly_id").withColumn("text_content", text), F.col("_at"))


def resolution_texts(anomalies: DataFrame, feedback: DataFrame) -> DataFrame:
    """Knowledge text of every remembered action with a comment."""
    notes = F.btrim("comment", F.lit(" \t\r\n\f\x0b"))
    useful = feedback.where(F.col("action").isin(*REMEMBERED_ACTIONS) & (notes != ""))
    subject = anomalies.select(
        F.col("id").alias("anomaly_id"), "application", "environment", "template_id", "template_text", "anomaly_type"
    )
    text = F.concat(
        F.lit(RESOLUTION_MARK + " - "), F.col("application"), F.lit("/"), F.col("environment"),
        F.lit("] Incident Template: "), F.col("template_text"), F.lit(" | Anomaly Type: "), F.col("anomaly_type"),
        F.lit(" | " + NOTES_MARK + " "), notes,
    )
    joined = useful.join(subject, "anomaly_id").withColumn("text_content", text)
    return joined.select("anomaly_id", "template_id", "text_content", "created_at")


def index_resolutions(anomalies: DataFrame, feedback: DataFrame) -> DataFrame:
    """Memory records of how incidents were resolved."""
    return _records(resolution_texts(anomalies, feedback), F.col("created_at"))


def resolution_notes(text: Column) -> Column:
    """The notes inside a resolution record, null if there are none."""
    after = F.substr(text, F.position(F.lit(NOTES_MARK), text) + len(NOTES_MARK))
    notes = F.btrim(after, F.lit(" \t\r\n\f\x0b"))
    return F.when(text.contains(NOTES_MARK) & (notes != ""), notes)

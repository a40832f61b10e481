"""What a task holds at once stays bounded, whatever the number of rows."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from lanternlog.operators import clustering, memory, vector_lists
from lanternlog.plans import queries as registered
from lanternlog.plans import views
from lanternlog.sources import cloudwatch


def _vectors(rows: int, key: str, seed: int) -> pd.DataFrame:
    return pd.DataFrame({key: np.arange(rows), "embedding": list(np.random.default_rng(seed).normal(size=(rows, 16)))})


def _peak_mb(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_scores_of_a_batch_are_held_in_parts():
    queries, stored = _vectors(500, "query_id", 1), _vectors(10_000, "id", 2)
    search = memory._partial_search(queries, 5, -1.0, True)
    assert _peak_mb(lambda: list(search(iter([stored])))) < 100


@pytest.mark.parametrize("self_match", [True, False])
def test_parts_of_any_size_find_the_same(self_match):
    queries, stored = _vectors(30, "query_id", 1), _vectors(400, "id", 1)
    # Copies tie on their scores; the smaller id comes first.
    stored = pd.concat([stored, stored.assign(id=stored["id"] + 400)])
    wanted = None
    for cells in (1, 700, 1 << 20):
        found = pd.concat(memory._partial_search(queries, 5, 0.1, self_match, cells)(iter([stored[:300], stored[300:]])))
        found = found.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).to_numpy().tolist()
        wanted = wanted or found
        assert found == wanted
    best = {query: [row[1] for row in wanted if row[0] == query] for query in range(30)}
    assert all((query in ids) == self_match and query + 400 in ids for query, ids in best.items())


class _Mapped:
    """Stands for a table of queries and keeps the function that is mapped over it."""

    def __init__(self, schema):
        self.schema = schema

    def mapInPandas(self, function, schema):  # noqa: N802
        self.function = function
        return self


def test_queries_are_handed_on_in_parts_for_many_lists():
    from pyspark.sql import types as T

    queries, centres = _vectors(2_000, "query_id", 1), np.random.default_rng(2).normal(size=(500, 16))
    lists = vector_lists.Lists(None, {16: centres}, {16: np.zeros(500)}, {16: np.ones(500, np.int64)})
    table = _Mapped(T.StructType([T.StructField("query_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))]))
    vector_lists._asked(table, lists, lambda near, part, size: np.ones(near.shape, bool))
    sizes = [len(part) for part in table.function(iter([queries]))]
    assert sum(sizes) == 2_000 * 500
    assert max(sizes) <= vector_lists.PAIRS


def test_payloads_are_unpacked_once_and_in_small_batches(spark, capsys):
    payloads = spark.createDataFrame([(1, "")], "payload_id int, data string")
    lines, bad = cloudwatch.decode_cloudwatch(payloads)
    for rows in (lines, bad, lines.select("message")):
        rows.explain()
        plan = capsys.readouterr().out
        assert plan.count("BatchEvalPython") == 1 and "Arrow" not in plan


def test_payloads_are_packed_in_small_batches(spark, capsys):
    registered._payloads(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("BatchEvalPython") == 1 and "Arrow" not in plan


def _one_row_group(spark, folder, rows: int) -> None:
    """An events table of one row group, cut into more splits than there are cores."""
    table = spark.range(rows).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts", "id % 50 AS user_id",
        "'error' AS event_type", "id * 0.5D AS value", "sha2(string(id), 256) AS props",
    )
    table.toPandas().to_parquet(folder / "events.parquet", row_group_size=rows, coerce_timestamps="us")


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    _one_row_group(spark, tmp_path, 4_000)
    name = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(name, "8k")
    try:
        assert views.table(spark, str(tmp_path), "events").rdd.getNumPartitions() >= 8
        for dealt in (views.event_lines(spark, str(tmp_path)), views.event_observations(spark, str(tmp_path), dealt=True)):
            sizes = dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
            assert sum(sizes) == 4_000 and max(sizes) < 1_000
        spread = views.spread(views.table(spark, str(tmp_path), "events"), 100)
        assert spread.rdd.getNumPartitions() == 40
    finally:
        spark.conf.unset(name)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_no_file_holds_a_whole_language(spark, tmp_path, monkeypatch, compression):
    monkeypatch.setattr(views, "TEXT_ROWS", 10)
    texts = spark.range(200).selectExpr(
        "id AS doc_id", "concat('b ', id, '\\n\\na\\r', id) AS text", "if(id < 150, 'en', 'de') AS lang", "'web' AS source", "10L AS n_chars"
    )
    texts.toPandas().to_parquet(tmp_path / "documents.parquet")
    path = registered._written_lines(spark, str(tmp_path), compression)
    files = spark.read.option("recursiveFileLookup", "true").text(path).groupBy("_metadata.file_path").count().collect()
    assert len(files) > 2 and max(r["count"] for r in files) < 150
    rows = {tuple(r) for r in registered._numbered(spark, path).collect()}
    assert rows == {("en", 450, 450, 1, 450), ("de", 150, 150, 1, 150)}


def test_groups_of_a_batch_are_clustered_at_once():
    words = [f"w{i} only" for i in range(3_000)] + ["job 1 of a done", "job 2 of b done", "job 3 of c done"]
    groups = [f"g{i:05d}" for i in range(3_000)] + ["x"] * 3
    rows = pd.DataFrame({"group": groups, "leaf": "l", "node": words, "pattern": words, "first_seen": pd.Timestamp(0), "known": None})
    rows.loc[3_000, "known"] = "id-1"
    for step in (10_000, 1_000, 2_999, 3_001):
        frames = list(clustering._by_piece(0.4)(rows.iloc[i : i + step] for i in range(0, len(rows), step)))
        assert len(frames) <= -(-len(rows) // step) + 1
        found = pd.concat(frames)
        assert found["node"].tolist() == words and found["merged"].tolist()[:3_000] == words[:3_000]
        assert set(found["merged"].tolist()[3_000:]) == {"job <*> of <*> done"}
        assert found["template_id"].tolist() == [None] * 3_000 + ["id-1"] * 3

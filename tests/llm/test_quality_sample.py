"""What the driver gets to fit the cutoff: a row for each sampled id, however often it is repeated."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lanternlog.llm import quality


def test_a_repeated_id_is_one_score(spark):
    rows = [(7, "good words here")] * 500 + [(8, "bad bad words"), (9, "other"), (None, "words"), (7, "")]
    frame = spark.createDataFrame(rows, "_id bigint, _text string").select("_id", F.col("_text"))
    model = quality.Model(np.linspace(-1, 1, quality.BUCKETS))
    found = quality._scored(frame, model, np.array([7]), np.array([8])).collect()
    assert sorted((r._id, r.good) for r in found) == [(7, True), (8, False)]

"""From raw documents to packed sequences: language, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet before the next one
reads it. All but the last return the columns of ``documents``, with one row for each document that stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternlog.llm import language_id, packing, quality, simhash
from lanternlog.llm.common import stored


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; null texts, texts without letters, and texts farther from all profiles than any labelled one go."""
    profiles = language_id.learn_profiles(docs)
    return language_id.keep_known(docs, language_id.learn_bounds(docs, profiles))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model learned from the labels does not reject."""
    return quality.keep_good(docs, quality.learn_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash values (three-word shingles) are linked by at most two differing bits.

    The document with the smallest id stays. Rows that repeat this id keep one of those with the smallest text digest, so
    copies of one text under one id become one row; another text under the id is a document of its own group or goes with
    this one. Rows without id stay, as nothing can be said to come before them.
    """
    return simhash.keep_first(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their ids and a checksum."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language_id", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]
#: Not sayable in SQL: two stages learn models, one walks a graph, one tokenizes. Tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

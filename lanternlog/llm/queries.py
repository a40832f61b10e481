"""The operators over the given tables, as registered queries."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternlog.llm import (
    bpe, hnsw, html_extract, language_id, merkle, packing, quality, simhash, syncmers, token_counts, token_files, topk, word_runs,
)
from lanternlog.session import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return language_id.predict(documents, language_id.learn_profiles(documents))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all documents, which of them are rejected, and half of the others drawn by weight."""
    documents = _table(spark, sf_dir, "documents")
    model = quality.learn_model(documents, _table(spark, sf_dir, "labels"))
    return quality.resample(quality.weigh(documents, model))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_files.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_edits(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_words(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.link_near(_table(spark, sf_dir, "embeddings"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_extract.main_text(pages, html_extract.learn(pages))


def repeated_tail(key: int | None, n: int) -> np.ndarray | None:
    """For a tenth of the ids: the original word at each place, where the words from one place on repeat its first few."""
    h = 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return np.r_[np.arange(a), a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))]


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs.periodic_runs(_table(spark, sf_dir, "documents"), arrange=repeated_tail)
    best = found.withColumn("best", word_runs.densest())
    return best.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(word_runs.lines(), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = merkle.leaf_digest([F.col(c) + 1 if c == "n_chars" else c for c in columns])
    some = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    found = merkle.manifest(
        _table(spark, sf_dir, "documents"), merkle.leaf_digest(columns), carry={"tampered": F.when(some, tampered)}
    ).withColumn("node", F.coalesce("tampered", "leaf")).withColumn("folded_root", F.expr(merkle.fold("node", "path")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("path", ""), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.scaled(_table(spark, sf_dir, "embeddings"), 64)
    return topk.best_products(vectors, F.col("vec_id") % 20 == 0, 20)


REGISTRY = {
    f.__name__: f
    for f in (
        op1_language_id, op2_quality, op3_packing, op4_token_files, op5_simhash, op6_fingerprints, op7_bpe, op8_token_counts,
        op9_embeddings, op10_main_text, op11_word_runs, op12_merkle, op13_topk,
    )
}
_CRC = """xor(list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
    lambda c, x: list_reduce(list_prepend(xor(c, x), list_transform(range(8), lambda i: 0::UBIGINT)),
        lambda s, i: xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))), 4294967295::UBIGINT)"""


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _leaf(chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', chars, 'text')))})"


def _pairs(name: str, start: str, key: str) -> str:
    """CTE of all levels of trees: each row is a node with its neighbours; a tree ends with its only node."""
    flank = f"OVER (PARTITION BY {key} ORDER BY pos)"
    side = f"CASE WHEN pos % 2 = 1 THEN lag(node) {flank} END AS l, CASE WHEN pos % 2 = 0 THEN lead(node) {flank} END AS r"
    return f"""{name} AS (
    SELECT 0 AS level, {key}, pos, node, {side}, count(*) OVER (PARTITION BY {key}) AS nodes FROM {start}
    UNION ALL
    SELECT level + 1, {key}, pos, node, {side}, count(*) OVER (PARTITION BY {key}) FROM (
        SELECT level, {key}, pos // 2 AS pos, sha256(node || coalesce(r, '')) AS node FROM {name} WHERE nodes > 1 AND pos % 2 = 0)
)"""


#: The other queries cannot be said in SQL: they learn models, tokenize, hash with XXH64, walk graphs, or compare every period of
#: every text (op11). Tests use brute force.
ORACLES: dict[str, str] = {
    "op12_merkle": f"""WITH RECURSIVE leaves AS (
    SELECT doc_id, coalesce(lang, '') AS grp, lang IS NULL AS none, {_leaf('n_chars')} AS node,
        CASE WHEN {_CRC} % 7 = 0 THEN {_leaf('n_chars + 1')} END AS tampered FROM documents
), placed AS (
    SELECT *, (none, grp) AS tree, row_number() OVER (PARTITION BY none, grp ORDER BY doc_id NULLS FIRST, node) - 1 AS pos FROM leaves
), {_pairs('inner_levels', 'placed', 'tree')}, subroots AS (
    SELECT 0 AS whole, tree, level AS height, node, row_number() OVER (ORDER BY tree[1] DESC, encode(tree[2])) - 1 AS pos
    FROM inner_levels WHERE nodes = 1
), {_pairs('outer_levels', 'subroots', 'whole')}, ends AS (SELECT level AS height, node AS root FROM outer_levels WHERE nodes = 1
), flanks AS (
    SELECT p.tree, p.pos, list(struct_pack(l := coalesce(n.l, ''), r := coalesce(n.r, '')) ORDER BY n.level) AS f
    FROM placed p JOIN inner_levels n ON n.tree = p.tree AND n.pos = p.pos >> n.level AND n.nodes > 1 GROUP BY ALL
), tops AS (
    SELECT p.tree, list(struct_pack(l := coalesce(n.l, ''), r := coalesce(n.r, '')) ORDER BY n.level) AS f
    FROM subroots p JOIN outer_levels n ON n.pos = p.pos >> n.level AND n.nodes > 1 GROUP BY ALL
), paths AS (
    SELECT p.doc_id, p.node AS leaf, coalesce(p.tampered, p.node) AS changed, s.node AS subroot, e.root,
        list_concat(coalesce(f.f, []), coalesce(t.f, [])) AS path
    FROM placed p JOIN subroots s ON s.tree = p.tree CROSS JOIN ends e
    LEFT JOIN flanks f ON f.tree = p.tree AND f.pos = p.pos LEFT JOIN tops t ON t.tree = p.tree
), folded AS (
    SELECT *, list_reduce(list_prepend(struct_pack(l := changed, r := ''), path),
        lambda h, x: struct_pack(l := sha256(x.l || h.l || x.r), r := '')).l AS folded_root FROM paths
) SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) AS proof_sha256,
    folded_root, folded_root = root AS verified FROM folded""",
    "op13_topk": """WITH v AS (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS cells FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.cells, c.cells)::BIGINT AS score
    FROM v q JOIN v c ON q.row <> c.row AND len(q.cells) = len(c.cells) WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank, vec_id, score FROM scored
) SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
}

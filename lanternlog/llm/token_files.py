"""Flat files of token ids: unsigned integers, 64-bit document offsets, and a manifest with each file's base."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternlog.llm.byte_ids import byte_ids
from lanternlog.llm.common import map_batches, offsets_of, shuffle_parts, slices
from lanternlog.session import file_system

#: Stands for a null document id in the files.
NULL_ID = np.iinfo(np.int64).min
#: Ids that a reading task hands on at once.
READ_IDS = 1 << 20


def write_tokens(
    df: DataFrame, path: str, folder: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text",
    parts: int | None = None,
) -> dict:
    """Write the ids of all documents, in ascending order of ``id_col``, to ``folder``; returns the manifest.

    Each range of ids becomes three flat little-endian files: ``.ids`` (uint16 if the vocabulary allows it, else uint32; every
    document is followed by ``end``), ``.offsets`` (int64, one more than documents, from 0) and ``.docs`` (int64 document ids).
    A file's base, the number of ids in all files before it, is a prefix sum over one row per file. Every task attempt
    writes files of its own name, and the manifest names those of the attempts that Spark accepted, so lost executors and
    speculative copies leave no trace. Null texts are empty; null ids come first; rows that repeat an id are ordered by text.
    ``folder`` must be reachable from all executors. An empty table gives a manifest without files.
    """
    os_fs, root = file_system(folder)
    os_fs.create_dir(root, recursive=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, context = byte_ids(path), TaskContext.get()
        kind = "<u2" if max(table.size, end + 1) <= 1 << 16 else "<u4"
        part = context.partitionId() if context else 0
        name = f"part-{part:06d}-{context.taskAttemptId() if context else 0}"
        there, top = file_system(folder)
        docs = total = 0
        files = None
        for batch in slices(batches):
            if files is None:
                files = [there.open_output_stream(f"{top}/{name}.{x}") for x in ("ids", "offsets", "docs")]
                files[1].write(np.zeros(1, "<i8").tobytes())
            ids, begins = table.encode(batch.column(1), end)
            files[0].write(ids.astype(kind).tobytes())
            files[1].write((total + begins[1:]).astype("<i8").tobytes())
            files[2].write(np.asarray(batch.column(0).fill_null(NULL_ID)).astype("<i8").tobytes())
            docs, total = docs + batch.num_rows, total + len(ids)
        if files:
            for file in files:
                file.close()
            columns = [pa.array([part]), pa.array([name]), pa.array([kind]), pa.array([docs]), pa.array([total])]
            yield pa.RecordBatch.from_arrays(columns, ["part", "name", "kind", "docs", "ids"])

    ranged = (
        df.select(F.col(id_col).cast("bigint").alias(id_col), text_col)
        .repartitionByRange(parts or shuffle_parts(df.sparkSession), id_col)
        .sortWithinPartitions(id_col, text_col)
    )
    rows = map_batches(ranged, work, "part bigint, name string, kind string, docs bigint, ids bigint").collect()
    rows = sorted(rows, key=lambda r: r.part)
    bases = offsets_of(np.array([r.ids for r in rows], np.int64)).tolist()
    manifest = {
        "end": end,
        "total": bases[-1],
        "files": [r.asDict() | {"base": base} for r, base in zip(rows, bases, strict=False)],
    }
    with os_fs.open_output_stream(f"{root}/manifest.json") as file:
        file.write(json.dumps(manifest).encode())
    return manifest


def _mapped(there: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """The numbers of a file: memory-mapped where the file system is mounted, else read."""
    if isinstance(there, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r") if there.get_file_info(path).size else np.zeros(0, kind)
    with there.open_input_file(path) as file:
        return np.frombuffer(file.read_buffer(), kind)


def read_tokens(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of every document in the files of ``folder``.

    ``start`` counts the ids of all documents before it; ``ids`` are little-endian unsigned 32-bit numbers. One task per file.
    """
    there, root = file_system(folder)
    with there.open_input_file(f"{root}/manifest.json") as file:
        files = json.loads(file.read())["files"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, top = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                docs = _mapped(here, f"{top}/{row['name']}.docs", "<i8")
                offsets = _mapped(here, f"{top}/{row['name']}.offsets", "<i8")
                ids = _mapped(here, f"{top}/{row['name']}.ids", row["kind"])
                cuts = np.r_[0, np.flatnonzero(np.diff(offsets[1:] // READ_IDS)) + 1, len(docs)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    some = ids[offsets[a] : offsets[b]].astype("<u4")
                    bounds = (4 * (offsets[a : b + 1] - offsets[a])).tolist()
                    raw = some.tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs[a:b], mask=docs[a:b] == NULL_ID),
                            pa.array(row["base"] + offsets[a:b]),
                            pa.array(np.diff(offsets[a : b + 1])),
                            pa.array([raw[x:y] for x, y in zip(bounds, bounds[1:], strict=False)], pa.binary()),
                        ],
                        [id_col, "start", "n_tokens", "ids"],
                    )

    listed = spark.createDataFrame(
        [(f["name"], f["kind"], f["base"]) for f in files], "name string, kind string, base bigint"
    ).coalesce(1).repartition(max(1, len(files)))
    return map_batches(listed, work, f"`{id_col}` bigint, start bigint, n_tokens bigint, ids binary")

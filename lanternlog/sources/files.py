"""Text log files, plain or compressed."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternlog.operators.ranking import small_table
from lanternlog.schemas import RAW_LINES, SETTLED_LINES, SOURCE_FILES, conform
from lanternlog.session import materialize


def read_log_files(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """Lines of text files as ``(source_path, line_number, line)``; numbers start at 1 in each file.

    Compressed files are read by their extension. Invalid UTF-8 is replaced.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    return number_lines(reader.text(paths).select(*_line_columns()))


def _line_columns() -> list[Column]:
    return [
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.make_valid_utf8("value").alias("line"),
    ]


def split_index(lines: DataFrame) -> DataFrame:
    """One row per split of a text scan: file, block, lines, row id of the first, and lines of the file before it.

    Stored once; it numbers the lines and lists the files, so the text is read once more and no further time.
    """
    before = W.partitionBy("source_path").orderBy("block_start").rowsBetween(W.unboundedPreceding, -1)
    index = (
        lines.withColumn("_row", F.monotonically_increasing_id())
        .groupBy("source_path", "block_start")
        .agg(F.count(F.lit(1)).alias("_lines"), F.min("_row").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_lines").over(before), F.lit(0)))
    )
    return index if lines.isStreaming else materialize(index)


def number_lines(lines: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Number the lines of a text scan (``source_path``, ``block_start``, ``line``) without sorting any file.

    Each split counts its lines; the counts of the splits before give a split its first number. The table of
    splits has one row per block of a file and goes to all tasks if it is small, so that no line is shuffled. ``lines``
    must be in the order and partitions of the scan, and ``index`` its ``split_index``.
    """
    blocks = split_index(lines) if index is None else index
    if not lines.isStreaming:
        blocks = F.broadcast(blocks) if small_table(blocks) else blocks
    number = F.col("_before") + F.col("_row") - F.col("_first") + 1
    tagged = lines.withColumn("_row", F.monotonically_increasing_id())
    return tagged.join(blocks, ["source_path", "block_start"]).select(
        "source_path", number.alias("line_number"), "line"
    )


def stream_log_files(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of the lines of rolled files. Its micro-batches hold whole files, so ``number_lines`` works on them.

    ``modified`` is the time of the file, the same on every delivery.
    """
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    text = reader.text(path)
    return text.select(*_line_columns(), F.col("_metadata.file_modification_time").alias("modified"))


def _qualified(spark: SparkSession, path: str) -> str:
    """``path`` as the file system names it, as in the file paths of a scan."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(name).toString()
    return re.sub("^file:/+", "file:/", full)


def _root(path: str) -> str:
    """The part of a path before its first wildcard, in whole folders."""
    plain = re.split(r"[*?\[{]", path)[0]
    return path if plain == path else plain.rsplit("/", 1)[0]


def _glob_pattern(path: str) -> str:
    """Regular expression for the paths that a path with wildcards stands for."""
    simple = {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|"}
    deep, parts = 0, []
    for piece in re.split(r"(\[[^\]]*\]|[*?{},])", path):
        deep += (piece == "{") - (piece == "}")
        if piece == "," and not deep:
            parts.append(",")
        elif piece in simple:
            parts.append(simple[piece])
        else:
            parts.append(piece if piece.startswith("[") else re.escape(piece))
    return "".join(parts)


def _scans(paths: list[str]) -> list[list[str]]:
    """Paths in as few scans as possible such that no file is reached twice by one scan."""
    scans: list[tuple[list[str], set[str], set[str]]] = []
    for path in sorted(set(paths)):
        root = _root(path)
        above = {root[:i] for i, c in enumerate(root) if c == "/"}
        for held, roots, parents in scans:
            if root not in roots and root not in parents and not above & roots:
                break
        else:
            held, roots, parents = [], set(), set()
            scans.append((held, roots, parents))
        held.append(path)
        roots.add(root)
        parents |= above
    return [held for held, _, _ in scans]


def read_source_lines(spark: SparkSession, sources: DataFrame, ingest_ts: str) -> DataFrame:
    """Raw lines of every source in the catalog, with its settings; ``ingest_ts`` is the time of the run as text.

    The columns of the raw line contract are followed by ``format``, ``multiline_pattern`` and ``multiline_negate``, which the
    assembly and parsing of records heed. Sources whose paths lie apart are read by one scan, however many they are, and
    each file finds its sources by its own path or one of its folders. A file of several sources is read for each of them.
    """
    settings = ("format", "multiline_pattern", "multiline_negate")
    catalog = [(_qualified(spark, row.path), row.asDict()) for row in sources.collect()]
    scans = []
    for paths in _scans([path for path, _ in catalog]):
        chosen = set(paths)
        rows = [
            (_root(path), _glob_pattern(path), row["id"], row["application"], row["environment"], row["source_name"], *[row[c] for c in settings])
            for path, row in catalog if path in chosen
        ]
        owners = spark.createDataFrame(rows, SOURCE_FILES)
        owners = F.broadcast(owners) if small_table(owners) else owners
        text = spark.read.text(paths).select(*_line_columns())
        index = split_index(text)
        scans.append(_owned(number_lines(text, index), index.select("source_path").distinct(), owners))
    if not scans:
        return conform(spark.createDataFrame([], RAW_LINES), SETTLED_LINES)
    union = scans[0]
    for part in scans[1:]:
        union = union.unionByName(part)
    return conform(union.withColumn("ingest_ts", F.lit(ingest_ts).cast("timestamp")), SETTLED_LINES)


def _owned(lines: DataFrame, files: DataFrame, owners: DataFrame) -> DataFrame:
    """Lines with the columns of the sources that their file belongs to; ``files`` are the paths that occur."""
    plain = F.regexp_replace("source_path", "^file:/+", "file:/")
    file = F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))
    names = F.split("_file", "/")
    # The file and all its folders: a source names one of them, or one stands before its first wildcard.
    folders = F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.array_join(F.slice(names, 1, n), "/"))
    reached = files.withColumn("_file", file).select("source_path", "_file", F.explode(folders).alias("_root")).join(owners, "_root")
    # Wildcards and folders reach the files named, or those directly inside a folder named.
    folder = F.regexp_replace("_file", "/[^/]*$", "")
    whole = F.concat(F.lit("^"), F.col("_pattern"), F.lit("$"))
    found = materialize(
        reached.where(F.rlike(F.col("_file"), whole) | F.rlike(folder, whole)).drop("_file", "_root", "_pattern")
    )
    return lines.join(F.broadcast(found) if small_table(found) else found, "source_path")

"""Session settings and the shared working folder."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "lanternlog", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are tuned for; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or a folder in the session's warehouse where that is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.work"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a path or URI that the Python side writes to, and the path in it."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers of this session import the package, wherever it was installed; done once per context."""
    context = spark.sparkContext
    if getattr(context, "_lanternlog_shipped", False):
        return
    folder = Path(__file__).resolve().parent
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(folder.rglob("*.py")):
            archive.write(path, str(path.relative_to(folder.parent)))
    target = f"{shared_dir(spark)}/lanternlog-{uuid.uuid4().hex}.zip"
    # Through Spark's own file systems, so that any shared folder will do.
    path = context._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    out.write(content.getvalue())
    out.close()
    context.addPyFile(target)
    context._lanternlog_shipped = True


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder, or that of ``scratch``, that no other run uses."""
    shared = shared_dir(spark)
    return f"{_FOLDER.get() or shared}/{name}-{uuid.uuid4().hex}"


def _hadoop_path(spark: SparkSession, path: str) -> tuple:
    """A path and its file system as Spark sees them, so that any shared folder will do."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder_sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes of each folder right under ``path``, by its name."""
    at, system = _hadoop_path(spark, path)
    found = [x.getPath() for x in system.listStatus(at) if x.isDirectory()]
    return {x.getName(): system.getContentSummary(x).getLength() for x in found}


def delete(spark: SparkSession, path: str) -> None:
    at, system = _hadoop_path(spark, path)
    system.delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for all that ``stored`` writes inside the block. It goes when the block ends, so results must be written elsewhere."""
    folder = new_path(spark, "scratch")
    token = _FOLDER.set(folder)
    try:
        yield folder
    finally:
        _FOLDER.reset(token)
        delete(spark, folder)


def write_compact(df: DataFrame, path: str, mode: str = "errorifexists", by: str | None = None) -> None:
    """Write Parquet that takes little disk. The shuffle files of the write go when it ends."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, mode=mode, partitionBy=by, compression="zstd")
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage and keeps columns apart."""
    path = new_path(df.sparkSession, name)
    if _FOLDER.get():
        write_compact(df, path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

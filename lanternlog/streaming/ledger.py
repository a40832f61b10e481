"""Tables of sums that a stream adds to: one small delta per micro-batch, folded into day partitions by a compaction.

Layout of a ledger's folder:

    deltas/batch=N/           what micro-batch N adds; a repeated batch writes the same folder again
    base/v=V/day=D/           sums of whole days, as version V of the manifest left them
    manifests/V.json          the days and their folders, and the last batch they hold

A reader takes the newest manifest and the deltas of later batches, so it sees one version whatever a compaction is doing, and a batch
that is delivered again after it was folded changes nothing. A manifest is put in place by a rename that fails if the version
exists. Nothing that the newest two manifests need is deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import date, datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternlog.sources.tables import read_table

#: Manifests whose files stay readable.
KEPT_VERSIONS = 2
#: Columns that are added up, each with its aggregate; the other columns are the key.
Sums = Mapping[str, Callable[[str], Column]]


class Files:
    """The few operations on a shared folder that a ledger needs, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._io = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        self._folder = folder
        self._system = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self._folder}/{name}"

    def names(self, name: str) -> list[str]:
        path = self._path(self.path(name))
        return sorted(s.getPath().getName() for s in self._system.listStatus(path)) if self._system.exists(path) else []

    def exists(self, name: str) -> bool:
        return self._system.exists(self._path(self.path(name)))

    def read(self, name: str) -> Any:
        stream = self._system.open(self._path(self.path(name)))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, name: str, value: Any, replace: bool = False) -> None:
        """Write a file as a whole; an error if there is one of that name, unless it may be replaced."""
        target, written = self._path(self.path(name)), self._path(self.path(f"writing-{uuid.uuid4().hex}"))
        stream = self._system.create(written)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        self._system.mkdirs(target.getParent())
        if replace:
            self._system.delete(target, False)
        if self._system.exists(target) or not self._system.rename(written, target):
            self._system.delete(written, False)
            raise FileExistsError(f"{name} was written by another run")

    def delete(self, name: str) -> None:
        self._system.delete(self._path(self.path(name)), True)


_NOTHING: dict[str, Any] = {"version": 0, "through": -1, "days": {}}


def append(df: DataFrame, folder: str, batch_id: int) -> None:
    """Add the sums of a micro-batch, in place of what an earlier delivery of it wrote."""
    df.write.mode("overwrite").parquet(f"{folder}/deltas/batch={batch_id}")


def newest(files: Files) -> dict[str, Any]:
    versions = [n for n in files.names("manifests") if n.endswith(".json")]
    return files.read(f"manifests/{versions[-1]}") if versions else _NOTHING


def _batches(files: Files) -> list[int]:
    """Numbers of the micro-batches whose deltas are complete, up to the first that is not."""
    numbers = sorted(int(n.partition("=")[2]) for n in files.names("deltas") if n.startswith("batch="))
    whole = []
    for number in numbers:
        if not files.exists(f"deltas/batch={number}/_SUCCESS"):
            break
        whole.append(number)
    return whole


def _rows(
    spark: SparkSession, files: Files, schema: T.StructType, days: Sequence[str], batches: Sequence[int], manifest: dict[str, Any]
) -> DataFrame:
    paths = [files.path(manifest["days"][d]) for d in days] + [files.path(f"deltas/batch={b}") for b in batches]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _summed(rows: DataFrame, sums: Sums) -> DataFrame:
    keys = [c for c in rows.columns if c not in sums]
    return rows.groupBy(*keys).agg(*[add(c).alias(c) for c, add in sums.items()])


def totals(
    spark: SparkSession, folder: str, schema: T.StructType, sums: Sums, days: tuple[date, date] | None = None, day_of: str | None = None
) -> DataFrame:
    """The sums so far; ``days`` keeps those whose time in column ``day_of`` is in a range of days, and reads only these."""
    files = Files(spark, folder)
    manifest = newest(files)
    wanted = [d for d in manifest["days"] if days is None or days[0].isoformat() <= d <= days[1].isoformat()]
    later = [b for b in _batches(files) if b > manifest["through"]]
    rows = _rows(spark, files, schema, wanted, later, manifest)
    if days is not None:
        rows = rows.where(F.to_date(day_of).between(F.lit(days[0]), F.lit(days[1])))
    return _summed(rows, sums)


def compact(
    spark: SparkSession, folder: str, schema: T.StructType, sums: Sums, day_of: str,
    now: datetime | None = None, keep_hours: int | None = None,
) -> dict[str, Any]:
    """Fold complete deltas into the days they touch, drop days that ended ``keep_hours`` before ``now``; the new manifest.

    Other days keep their files; expired ones are dropped without being read. Files that only older manifests than the newest
    two name are deleted.
    """
    files = Files(spark, folder)
    manifest = newest(files)
    fresh = [b for b in _batches(files) if b > manifest["through"]]
    first = None if now is None or keep_hours is None else (now - timedelta(hours=keep_hours)).date()
    kept = {d: p for d, p in manifest["days"].items() if first is None or date.fromisoformat(d) >= first}
    if not fresh and kept == manifest["days"]:
        return manifest
    version = manifest["version"] + 1
    added = _rows(spark, files, schema, [], fresh, manifest).withColumn("day", F.to_date(day_of))
    if first is not None:
        added = added.where(F.col("day") >= F.lit(first))
    touched = sorted(r.day.isoformat() for r in added.select("day").distinct().collect())
    if touched:
        old = _rows(spark, files, schema, [d for d in touched if d in kept], [], manifest).withColumn("day", F.to_date(day_of))
        # A name of its own, so that a compaction that fails or loses the race leaves nothing that is read.
        target = f"base/v={version}-{uuid.uuid4().hex}"
        _summed(old.unionByName(added), sums).write.partitionBy("day").parquet(files.path(target))
        kept |= {d: f"{target}/day={d}" for d in touched}
    made = {"version": version, "through": max([manifest["through"], *fresh]), "days": dict(sorted(kept.items()))}
    files.put(f"manifests/{version:012d}.json", made)
    _vacuum(files)
    return made


def _vacuum(files: Files) -> None:
    """Delete what none of the newest manifests needs."""
    versions = [n for n in files.names("manifests") if n.endswith(".json")]
    # Before the first manifests, readers have the deltas alone.
    alive = [_NOTHING] * (KEPT_VERSIONS - len(versions)) + [files.read(f"manifests/{n}") for n in versions[-KEPT_VERSIONS:]]
    named = {p for m in alive for p in m["days"].values()}
    for version in files.names("base"):
        # A folder of a later version may be one that is being written.
        if int(version.partition("=")[2].partition("-")[0]) > alive[-1]["version"]:
            continue
        parts = [f"base/{version}/{d}" for d in files.names(f"base/{version}") if d.startswith("day=")]
        for part in parts:
            if part not in named:
                files.delete(part)
        if not any(p in named for p in parts):
            files.delete(f"base/{version}")
    for name in files.names("deltas"):
        if int(name.partition("=")[2]) <= alive[0]["through"]:
            files.delete(f"deltas/{name}")
    for name in versions[:-KEPT_VERSIONS]:
        files.delete(f"manifests/{name}")


def expire_batches(spark: SparkSession, folder: str, moment: str, now: datetime, keep_hours: int) -> list[int]:
    """Delete ``batch=N`` folders of a table of rows whose newest ``moment`` has outlived its window; their numbers."""
    table = read_table(spark, folder)
    if table is None:
        return []
    ends = table.groupBy("batch").agg(F.max(moment).alias("end"))
    old = ends.where(F.col("end") < F.lit(now - timedelta(hours=keep_hours)).cast("timestamp")).select("batch").collect()
    files = Files(spark, folder)
    for row in old:
        files.delete(f"batch={row.batch}")
    return sorted(r.batch for r in old)

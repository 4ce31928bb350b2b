"""Tables that change by versions: staged, audited, and published by one commit file.

A version is a list of files per partition value (its manifest).  A writer stages new files beside the published ones, audits what
it staged, and then creates the commit file of the next version.  That file is created exclusively, so of two writers that
started from one version the second fails, and readers see the old version or the new one, never a mixture.  Files are never
changed: a version takes over the files of partitions that its batch did not touch, a snapshot is a copy of a manifest, and
restoring one is a commit.  A writer that dies while it creates the commit file leaves an empty one: readers pass over it, later
writers get a ``Conflict`` until it is removed by hand.

    data/run=<id>/<partition>=<value>/*.parquet   manifests/<id>/   state/<id>/   commits/<version>   snapshots/<name>/

Spark reads and writes rows and manifests.  The driver handles names only: runs and partition values, never rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .files import Files

NO_VALUE = "__HIVE_DEFAULT_PARTITION__"  # how Spark names the folder of null


class Refused(RuntimeError):
    """A batch did not pass its audit; the published version is as it was."""

    def __init__(self, points: int, failures: int):
        super().__init__(f"{failures} of {points} points failed")
        self.points, self.failures = points, failures


class Conflict(RuntimeError):
    """Another writer published first."""


@dataclass(frozen=True)
class Version:
    number: int
    run: str


def merge_rows(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old and new rows, the new one where both have the key.

    Of several new rows with one key the first in the order of their other columns stays, so that reruns agree.
    """
    both = old.withColumn("_rank", F.lit(1)).unionByName(new.withColumn("_rank", F.lit(0)), allowMissingColumns=True)
    others = [F.col(f"`{c}`").asc_nulls_last() for c in old.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy("_rank", *others)
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_rank")


class PublishedTable:
    """A table of versions under ``root``, in one folder per value of ``partition``."""

    def __init__(self, spark: SparkSession, root: str, partition: str, keys: Sequence[str], point: str | None = None, period: str | None = None):
        """``point`` and ``period``: columns whose latest period per point is kept as the table's state (see ``watermarks``)."""
        self.spark, self.root, self.partition, self.keys = spark, root.rstrip("/"), partition, list(keys)
        self.point, self.period = point, period
        self.files = Files(spark, self.root)

    # -- reading ---------------------------------------------------------------

    def current(self) -> Version | None:
        """The latest committed version; a commit file still without its line does not count."""
        for name in reversed(self.files.names("commits")):
            run = self.files.text(f"commits/{name}")
            if run.endswith("\n"):
                return Version(int(name), run.strip())
        return None

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.files.text("schema")))

    def _at(self, version: int | None) -> Version | None:
        if version is None:
            return self.current()
        return Version(version, self.files.text(f"commits/{version:08d}").strip())

    def manifest(self, version: int | None = None) -> DataFrame | None:
        """value, run, file, rows: the files of a version."""
        at = self._at(version)
        return self.spark.read.parquet(f"{self.root}/manifests/{at.run}") if at else None

    def read(self, version: int | None = None, values: Sequence[str] | None = None) -> DataFrame | None:
        """The rows of a version, of some partition values if named; None before the first version."""
        at = self._at(version)
        return self._rows(self.manifest(at.number), values) if at else None

    def _rows(self, manifest: DataFrame, values: Sequence[str] | None = None) -> DataFrame:
        places = manifest.select("run", "value").distinct()
        if values is not None:
            places = places.where(F.coalesce("value", F.lit(NO_VALUE)).isin(*values)) if values else places.limit(0)
        folders = [f"{self.root}/data/run={r.run}/{self.partition}={NO_VALUE if r.value is None else r.value}" for r in places.orderBy("run", "value").collect()]
        schema = self.schema()
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(self.schema().add("run", "string")).option("basePath", f"{self.root}/data").parquet(*folders).select(*schema.names)

    def watermarks(self) -> DataFrame | None:
        """point, last: the latest period of each point, from the state beside the version; the table is not read."""
        at = self.current()
        return self.spark.read.parquet(f"{self.root}/state/{at.run}") if at and self.point else None

    # -- writing ---------------------------------------------------------------

    def _stage(self, rows: DataFrame, run: str) -> DataFrame:
        """Write rows as run ``run``; returns the manifest of its files."""
        if rows.schema[self.partition].dataType.typeName() not in ("date", "integer", "long", "short"):
            raise ValueError(f"{self.partition}: partitions are dates or whole numbers")
        if "run" in rows.columns:
            raise ValueError("run is a name of the table's own")
        self.files.create("schema", rows.schema.json())  # the first writer's stays
        folder = f"{self.root}/data/run={run}"
        # the engine balances the parts: a large month becomes several files, small ones do not become many
        rows.hint("rebalance", self.partition).write.partitionBy(self.partition).parquet(folder)
        if not any(n.startswith(f"{self.partition}=") for n in self.files.names(f"data/run={run}")):
            return self.spark.createDataFrame([], "value string, run string, file string, rows long")
        kind = rows.schema[self.partition].dataType.simpleString()
        staged = self.spark.read.schema(f"`{self.partition}` {kind}").parquet(folder)
        value = F.col(self.partition).cast("string")
        per = staged.select(value.alias("value"), F.col("_metadata.file_path").alias("file")).groupBy("value", "file").agg(F.count(F.lit(1)).alias("rows"))
        return per.select("value", F.lit(run).alias("run"), "file", "rows")

    def _commit(self, base: Version | None, run: str) -> Version:
        number = base.number + 1 if base else 1
        if not self.files.create(f"commits/{number:08d}", f"{run}\n"):
            raise Conflict(f"version {number} was published by another writer")
        return Version(number, run)

    def upsert(self, new: DataFrame, audit: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> Version:
        """Publish the table with ``new`` merged by key.  Only partitions that ``new`` touches are read and written.

        ``audit`` gets the staged rows of those partitions and the batch, and returns one row (points, failures, may_write); where that is false nothing
        is published and ``Refused`` is raised.  The staged files stay for inspection until ``vacuum``.  ``new`` is read a few times:
        hand in stored rows.
        """
        base, run = self.current(), uuid.uuid4().hex
        touched = [NO_VALUE if r.v is None else r.v for r in new.select(F.col(self.partition).cast("string").alias("v")).distinct().collect()]
        if base is None:
            first = merge_rows(new.limit(0), new, self.keys)
            staged = self._stage(first, run)
        else:
            old = self.read(base.number, touched)
            staged = self._stage(merge_rows(old, new, self.keys).select(*old.columns), run)
        if audit is not None:
            seen = self.spark.read.schema(self.schema()).parquet(f"{self.root}/data/run={run}") if touched else self.spark.createDataFrame([], self.schema())
            points, failures, passed = audit(seen, new).select("points", "failures", "may_write").first()
            if not passed:
                raise Refused(points, failures)
        if base is not None:
            kept = self.manifest(base.number)
            kept = kept.where(~F.coalesce("value", F.lit(NO_VALUE)).isin(*touched)) if touched else kept
            staged = kept.unionByName(staged)
        staged.coalesce(1).write.parquet(f"{self.root}/manifests/{run}")
        if self.point:
            delta = new.groupBy(F.col(self.point).alias("point")).agg(F.max(self.period).alias("last"))
            known = self.watermarks()
            state = delta if known is None else known.unionByName(delta).groupBy("point").agg(F.max("last").alias("last"))
            state.write.parquet(f"{self.root}/state/{run}")
        return self._commit(base, run)

    # -- snapshots -------------------------------------------------------------

    def snapshot(self, name: str) -> None:
        """Name the current version; a manifest is copied, no rows are."""
        at = self.current()
        self.manifest(at.number).coalesce(1).write.parquet(f"{self.root}/snapshots/{name}/manifest")
        if self.point:
            self.watermarks().write.parquet(f"{self.root}/snapshots/{name}/state")

    def read_snapshot(self, name: str) -> DataFrame:
        return self._rows(self.spark.read.parquet(f"{self.root}/snapshots/{name}/manifest"))

    def restore(self, name: str) -> Version:
        """The snapshot's files become the next version; they are not copied, and what lies between stays readable by number."""
        base, run = self.current(), uuid.uuid4().hex
        self.spark.read.parquet(f"{self.root}/snapshots/{name}/manifest").coalesce(1).write.parquet(f"{self.root}/manifests/{run}")
        if self.point:
            self.spark.read.parquet(f"{self.root}/snapshots/{name}/state").write.parquet(f"{self.root}/state/{run}")
        return self._commit(base, run)

    def vacuum(self) -> list[str]:
        """Remove the files of runs that neither the current version nor a snapshot holds, refused ones included; returns their ids.

        Not for use beside a writer: what it is staging is in no manifest yet.  Older version numbers can no longer be read.
        """
        used = self.manifest().select("run")
        for name in self.files.names("snapshots"):
            used = used.union(self.spark.read.parquet(f"{self.root}/snapshots/{name}/manifest").select("run"))
        held = {r.run for r in used.distinct().collect()}
        gone = [n[4:] for n in self.files.names("data") if n.startswith("run=") and n[4:] not in held]
        for run in gone:
            self.files.remove(f"data/run={run}")
        return gone


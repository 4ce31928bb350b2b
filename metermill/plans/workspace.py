"""Named stages of the monthly run, each written once and then read.

A stage used by several jobs is a table in the folder the cluster shares
(``spark.checkpoint.dir``).  Reading it back cuts the lineage, survives the
loss of executors, and gives the optimizer real sizes: joins turn into
broadcasts only where the stored side is small enough for the session's
threshold.  A cluster must have that setting.
"""

from __future__ import annotations

import hashlib
import tempfile
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

from ..params import Params, driver_scale

CHECKPOINT_KEY = "spark.checkpoint.dir"
PARTITIONS_KEY = "spark.sql.shuffle.partitions"
ROWS_A_TASK = 500_000
METHOD_KEY = "spark.sql.codegen.hugeMethodLimit"
METHOD_BYTES = 8_000  # longer methods are interpreted by the JVM, not compiled
_local_root: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a private one only for local sessions."""
    conf = spark.conf.get(CHECKPOINT_KEY, None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_root:
        _local_root[app] = tempfile.mkdtemp(prefix="metermill-")
    return _local_root[app]


@contextmanager
def dealt(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffles planned inside have a task for every ``ROWS_A_TASK`` of ``rows``, and never fewer than the session asks for."""
    asked = spark.conf.get(PARTITIONS_KEY)
    spark.conf.set(PARTITIONS_KEY, str(max(int(asked), -(-rows // ROWS_A_TASK))))
    try:
        yield
    finally:
        spark.conf.set(PARTITIONS_KEY, asked)


@contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark fuses no operators into a method that the JVM would not compile, as long rules would make."""
    asked = spark.conf.get(METHOD_KEY)
    spark.conf.set(METHOD_KEY, str(min(int(asked), METHOD_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(METHOD_KEY, asked)


class Workspace:
    """Inputs, parameters and stages of one run."""

    def __init__(self, spark: SparkSession, source: str, params: Params | None = None):
        self.spark = spark
        self.source = source
        self.params = params or driver_scale()
        text = f"{spark.sparkContext.applicationId}|{source}|{self.params!r}"
        self.run_id = hashlib.sha1(text.encode()).hexdigest()[:12]
        self._built: dict[str, DataFrame] = {}
        self._parts: dict[str, Workspace] = {}
        self._lock = threading.RLock()  # parts are built side by side
        self.whole = self  # the workspace whose stages before the segments this one reads

    def folder(self, name: str) -> str:
        return f"{shared_folder(self.spark)}/{self.run_id}/{name}"

    def output(self, name: str) -> str:
        """Folder for files a caller asked for."""
        return self.folder(name)

    def part(self, params: Params) -> Workspace:
        """Workspace of one segment x target of this run."""
        key = repr(params)
        with self._lock:
            if key not in self._parts:
                self._parts[key] = Workspace(self.spark, self.source, params)
                self._parts[key].whole = self.whole
            return self._parts[key]

    def has(self, name: str) -> bool:
        with self._lock:
            return name in self._built

    def stage(
        self, name: str, build: Callable[[], DataFrame], bucket_by: str | None = None, rows: Callable[[], int] | None = None,
        long_rules: bool = False,
    ) -> DataFrame:
        """The stage's table, built on first use.  ``rows`` counts the input of a stage that reads whole tables;
        ``bucket_by`` is the key by which ``build`` has dealt out its rows; ``long_rules`` marks long conditions on each row."""
        with self._lock:
            if name not in self._built:
                path = self.folder(name)
                with dealt(self.spark, rows() if rows else 0), short_methods(self.spark) if long_rules else nullcontext():
                    if bucket_by:
                        self._built[name] = self._bucketed(name, path, build(), bucket_by)
                    else:
                        build().write.mode("overwrite").parquet(path)
                        self._built[name] = self.spark.read.parquet(path)
            return self._built[name]

    def _bucketed(self, name: str, path: str, df: DataFrame, key: str) -> DataFrame:
        """Hash-bucketed table: later joins and groupings on the key skip the shuffle."""
        n = int(self.spark.conf.get(PARTITIONS_KEY))
        table = f"metermill_{self.run_id}_{name}"
        (
            df.write.mode("overwrite").bucketBy(n, key).option("path", path).format("parquet").saveAsTable(table)
        )
        return self.spark.table(table)


_spaces: dict[tuple[str, str, str], Workspace] = {}


def workspace(spark: SparkSession, source: str, params: Params | None = None) -> Workspace:
    """One workspace per session, source and parameters."""
    params = params or driver_scale()
    key = (spark.sparkContext.applicationId, source, repr(params))
    if key not in _spaces:
        _spaces[key] = Workspace(spark, source, params)
    return _spaces[key]

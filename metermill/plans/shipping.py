"""The package on the executors' Python path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, also where the driver's path is not theirs.

    The archive is built on the driver and served by Spark, as with ``--py-files``.
    """
    sc = spark.sparkContext
    if getattr(sc, "_metermill_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="metermill-ship-"), "metermill.zip")
    with zipfile.ZipFile(target, "w") as z:
        for top, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(top, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(target)
    sc._metermill_shipped = True

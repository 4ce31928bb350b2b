"""Writers.  Every sink returns the relation read back from what it wrote."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numeric import nan_to_null
from .files import Files
from .published import PublishedTable
from .values import relation


def snk_replace(df: DataFrame, path: str, cluster: Sequence[str] = ("year", "month")) -> DataFrame:
    """Create or replace a table clustered by its months: range partitions keep
    months together, so file statistics skip the rest, without tiny files."""
    (
        df.repartitionByRange(*cluster).sortWithinPartitions(*cluster)
        .write.mode("overwrite").parquet(path)
    )
    return df.sparkSession.read.parquet(path)


def snk_overwrite(df: DataFrame, path: str) -> DataFrame:
    """Replace contents and schema; NaN is written as NULL."""
    nan_to_null(df).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def snk_snapshot(table: PublishedTable, name: str) -> DataFrame:
    """A published table as it is before a change, by a copy of its manifest; ``table.restore(name)`` brings it back."""
    table.snapshot(name)
    return table.read_snapshot(name)


def csv_ready(df: DataFrame) -> DataFrame:
    fixed = {f.name: F.col(f.name).cast("double") for f in df.schema.fields if f.dataType.typeName() == "decimal"}
    return df.withColumns(fixed) if fixed else df


def csv_cell(text: str) -> str:
    """A name as a CSV writer puts it into a header."""
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"' if any(c in text for c in ',"\n\r\\') else text


def snk_csv(df: DataFrame, folder: str, order: Sequence[str], prefix: str = "base") -> str:
    """One ordered CSV file with one header, named after its first and last month; returns its path.

    Spark sorts by ranges and writes one part a range; the parts become one file by the file system (``Files.join``), in the order of
    the ranges.  No row passes through the driver.  Without rows or months the file has its header and the plain prefix.
    """
    first, last = df.agg(
        F.date_format(F.min("period"), "yyyyMM"), F.date_format(F.max("period"), "yyyyMM")
    ).first()
    name = f"{prefix}_{first}-{last}.csv" if first else f"{prefix}.csv"
    parts = f"parts-{uuid.uuid4().hex}"
    ready = csv_ready(df)
    ready.orderBy(*order).write.option("header", False).csv(f"{folder}/{parts}")
    files = Files(df.sparkSession, folder)
    # part-00007-...csv: the number is the place of its range
    names = sorted((n for n in files.names(parts) if n.startswith("part-")), key=lambda n: int(n.split("-")[1]))
    files.join([f"{parts}/{n}" for n in names], name, ",".join(map(csv_cell, ready.columns)) + "\n")
    files.remove(parts)
    return f"{folder}/{name}"


def snk_sample(df: DataFrame, key: str = "series_key", percent: int = 50) -> DataFrame:
    """Whole series by the MD5 of their key, which other engines have too."""
    return df.where(F.conv(F.substring(F.md5(F.col(key).cast("binary")), 1, 8), 16, 10).cast("long") % 100 < percent)


def snk_bundle(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """One directory per named result."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder}/{name}"
        df.write.mode("overwrite").parquet(paths[name])
    return paths


def snk_params(spark: SparkSession, rows: Sequence[tuple[str, str]], path: str) -> DataFrame:
    """Parameters and assumptions next to the results."""
    relation(spark, [("premise", "string"), ("value", "string")], rows).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

"""Batch increments.  The sources revise their recent past, so each run reads a
few months again and upserts; nothing here is a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..params import CovariateParams
from ..sources.published import PublishedTable


def src_watermark(state: DataFrame | None, points: DataFrame, first_ever, p: CovariateParams) -> DataFrame:
    """Where each point starts to read: a few months before the last stored month, or the whole history for a point the table
    does not know.

    ``state`` (point, last) is what the published table keeps of each point (``PublishedTable.watermarks``), moved on by every
    batch from the batch alone; the stored readings are not scanned.  None: nothing is published yet.
    """
    if state is None:
        return points.withColumn("read_from", F.lit(first_ever))
    last = state.agg(F.max("last").alias("_last"))
    known = state.select(F.col("point").alias("ibge_code")).withColumn("_known", F.lit(True))
    rows = points.join(known, "ibge_code", "left").crossJoin(F.broadcast(last))
    back = F.add_months(F.col("_last"), -p.reread_months)
    start = F.when(F.col("_known") & F.col("_last").isNotNull(), back).otherwise(F.lit(first_ever))
    return rows.withColumn("read_from", start).drop("_known", "_last")


def snk_upsert(table: PublishedTable, new: DataFrame, audit: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """MERGE without a table format: the next version of the table, its untouched months by their old files."""
    table.upsert(new, audit)
    return table.read()


def set_subset(known: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Are all known keys in the table?"""
    missing = known.select(key).distinct().join(table.select(key).distinct(), key, "left_anti")
    return missing.agg(F.count("*").alias("missing")).withColumn("is_subset", F.col("missing") == 0)

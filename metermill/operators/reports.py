"""Small result tables: mixes, totals, annual and monthly summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.numeric import ratio


def with_share(df: DataFrame, value: str, keys: Sequence[str], out: str) -> DataFrame:
    """Share of each row in the total of ``keys`` (of everything if empty)."""
    if not keys:
        total = df.agg(F.sum(value).alias("_t"))
        return df.crossJoin(F.broadcast(total)).withColumn(out, ratio(value, "_t")).drop("_t")
    total = df.groupBy(*keys).agg(F.sum(value).alias("_t"))
    return df.join(total, list(keys)).withColumn(out, ratio(value, "_t")).drop("_t")


def agg_base_mix(base: DataFrame) -> DataFrame:
    """Volume, series and share by category x territory."""
    per_key = base.groupBy("category_detail", "territory", "series_key").agg(F.sum("vol_meas_water").alias("v"))
    mix = per_key.groupBy("category_detail", "territory").agg(F.sum("v").alias("vol"), F.count("*").alias("n_series"))
    return with_share(mix, "vol", [], "share")


def agg_magnitude(base: DataFrame, group: str, value: str, months: Sequence[int], as_share: bool) -> DataFrame:
    """Share or level by month of the latest year, months side by side, largest
    in the last month first."""
    last = base.agg(F.max(F.year("period")).alias("_y"))
    rows = base.crossJoin(F.broadcast(last)).where(F.year("period") == F.col("_y"))
    g = rows.groupBy(group, F.month("period").alias("mon")).agg(F.sum(value).alias("value"))
    if as_share:
        g = with_share(g, "value", ["mon"], "share").select(group, "mon", F.col("share").alias("value"))
    wide = g.groupBy(group).pivot("mon", list(months)).agg(F.first("value"))
    named = wide.select(group, *[F.col(str(m)).alias(f"m{m:02d}") for m in months])
    return named.orderBy(F.desc_nulls_last(f"m{months[-1]:02d}"), group)

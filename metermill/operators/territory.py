"""Aggregated base to series x size x month, ABC classes and series validity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dates import first_of_month, shift
from ..functions.numeric import percent, ratio, snap_round
from ..functions.text import blank_to_null
from ..functions.windows import running_share
from ..params import BaseParams
from ..rules import (
    EXCLUDED_DETAILS, REASON_CLOSED, REASON_NONE, REASON_UNITS, REASON_VOLUME, RESIDENTIAL, SOCIAL_PREFIX,
    TERRITORY_INFORMAL, TERRITORY_RURAL, TERRITORY_TOTAL, TERRITORY_URBAN,
)
from ..schemas import SERIES, SERIES_SIZE
from ..sources.values import relation

SUMS = [
    "vol_meas_water", "vol_meas_sewage", "vol_bill_water", "vol_bill_sewage", "units_water", "units_sewage",
    "conns_water", "conns_sewage", "n_bills", "days", "vol_meas_water_raw", "vol_bill_water_raw",
]


def prj_period(hist: DataFrame) -> DataFrame:
    """Month as a date and the six-digit municipality code."""
    return hist.withColumns(
        {"period": first_of_month("year", "month"), "ibge_code": F.substring(F.col("ibge_full").cast("string"), 1, 6)}
    )


def prj_sentinel(hist: DataFrame) -> DataFrame:
    return hist.withColumn("territory", blank_to_null("territory"))


def flt_excl(hist: DataFrame) -> DataFrame:
    """Category details without a model leave; a NULL detail leaves too."""
    return hist.where(~F.col("category_detail").isin(*EXCLUDED_DETAILS))


def override_table(spark: SparkSession, p: BaseParams) -> DataFrame:
    ddl = [("ibge_code", "string"), ("o_region", "string"), ("o_municipality", "string"), ("o_office", "int")]
    return relation(spark, ddl, p.overrides)


def prj_override(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    fixed = {c: F.coalesce(F.col(f"o_{c}"), F.col(c)) for c in ("region", "municipality", "office")}
    joined = rows.join(F.broadcast(overrides), "ibge_code", "left").withColumns(fixed)
    return joined.drop("o_region", "o_municipality", "o_office")


def prj_territory(rows: DataFrame, p: BaseParams) -> DataFrame:
    """Territory of the series, and whether it was filled in.

    Rows without a municipality drop, as an inner join on it would.
    """
    informal = rows.groupBy("municipality").agg(
        F.bool_or(F.col("territory") == TERRITORY_INFORMAL).alias("has_informal")
    )
    t, resid = F.col("territory"), F.col("category") == RESIDENTIAL
    rural_social = F.col("category_detail").startswith(SOCIAL_PREFIX) & (t == TERRITORY_RURAL)
    new = (
        F.when(~resid, TERRITORY_TOTAL)
        .when(t.isNull(), p.default_territory)
        .when(rural_social & F.col("has_informal"), TERRITORY_INFORMAL)
        .when(rural_social, TERRITORY_URBAN)
        .otherwise(t)
    )
    joined = rows.join(informal, "municipality")
    return joined.withColumn("territory_filled", resid & t.isNull()).withColumn("territory", new).drop("has_informal")


def prepared(hist: DataFrame, overrides: DataFrame, p: BaseParams) -> DataFrame:
    rows = flt_excl(prj_sentinel(prj_period(hist))).where(F.col("period") >= F.lit(p.first_period))
    return prj_territory(prj_override(rows, overrides), p)


def agg_series_month(hist: DataFrame, overrides: DataFrame, p: BaseParams) -> DataFrame:
    """Sum over category codes to series x size x month."""
    rows = prepared(hist, overrides, p)
    return rows.groupBy(*SERIES_SIZE, "period").agg(
        *[F.sum(c).alias(c) for c in SUMS],
        F.sum(F.when(F.col("territory_filled"), F.col("vol_meas_water")).otherwise(0.0)).alias("vol_meas_water_imputed"),
    )


# -- ABC --------------------------------------------------------------------


def last_period(df: DataFrame, name: str = "last") -> DataFrame:
    """One row: the last month of the relation."""
    return df.agg(F.max("period").alias(name))


def agg_municipality_12m(stage1: DataFrame, p: BaseParams) -> DataFrame:
    joined = stage1.crossJoin(F.broadcast(last_period(stage1)))
    recent = joined.where(F.col("period") > shift("last", -p.abc_months))
    return recent.groupBy("municipality").agg(F.sum("vol_meas_water").alias("vol"))


def win_cum_share(volumes: DataFrame) -> DataFrame:
    return running_share(volumes, "vol", "municipality", "cum_share")


def prj_abc(volumes: DataFrame, p: BaseParams) -> DataFrame:
    """A up to the first cut of the cumulative share, then B, then C.  The
    municipality that crosses a cut belongs to the next class."""
    share = F.col("cum_share")
    cls = F.when(share <= p.abc_cut_a, "A").when(share <= p.abc_cut_b, "B").otherwise("C")
    return win_cum_share(volumes).select("municipality", F.col("vol").alias("vol_abc"), "cum_share", cls.alias("abc_class"))


def dq_abc(abc: DataFrame) -> DataFrame:
    by = abc.groupBy("abc_class").agg(F.count("*").alias("municipalities"), F.sum("vol_abc").alias("v"))
    total = abc.agg(F.sum("vol_abc").alias("t"))
    return by.crossJoin(F.broadcast(total)).select("abc_class", "municipalities", percent("v", "t", 1).alias("pct_volume"))


# -- validity ---------------------------------------------------------------


def agg_series_stats(stage1: DataFrame, p: BaseParams) -> DataFrame:
    """Life and size of each series, size classes summed, and why it is out."""
    monthly = stage1.groupBy(*SERIES, "period").agg(
        F.sum("units_water").alias("units"), F.sum("vol_meas_water").alias("vol")
    )
    stats = monthly.groupBy(*SERIES).agg(
        F.count("*").alias("n_periods"),
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
        F.avg("units").alias("mean_units"),
        F.avg("vol").alias("mean_volume"),
    )
    return prj_validity(stats.crossJoin(F.broadcast(last_period(stage1, "base_last"))), p).drop("base_last")


def prj_validity(stats: DataFrame, p: BaseParams) -> DataFrame:
    reason = (
        F.when(F.col("last_period") < shift("base_last", -p.tolerance_months), REASON_CLOSED)
        .when(F.coalesce("mean_units", F.lit(0.0)) < p.min_units, REASON_UNITS)
        .when(F.coalesce("mean_volume", F.lit(0.0)) < p.min_volume, REASON_VOLUME)
    )
    return stats.withColumn("reason", reason)


def dq_series(stats: DataFrame) -> DataFrame:
    return stats.groupBy(F.coalesce("reason", F.lit(REASON_NONE)).alias("situation"), "category_detail").agg(
        F.count("*").alias("series"), snap_round(F.sum("mean_volume"), 0).alias("mean_monthly_volume")
    )


def jn_using7(stage1: DataFrame, stats: DataFrame) -> DataFrame:
    """Statistics next to each month; rows with a NULL key part drop."""
    return stage1.join(stats.select(*SERIES, "reason", "mean_volume"), SERIES)


def rb_valid(stage1: DataFrame, stats: DataFrame) -> DataFrame:
    return stage1.join(stats.where(F.col("reason").isNull()), SERIES, "left_semi")

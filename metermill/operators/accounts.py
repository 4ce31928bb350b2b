"""Account rules: size classes, absurd volumes, the aggregated base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions.dates import yyyymm
from ..functions.numeric import median, percent, ratio, snap_round
from ..params import AbsurdParams, SizeParams
from ..rules import FIRM_DEMAND, LARGE, OTHERS, SIZE_CATEGORIES
from ..sources.values import relation
from .facts import flt_account, has_account

VOLUMES = ("meas_water", "meas_sewage", "bill_water", "bill_sewage")


def jn_map_inner(fact: DataFrame, category_map: DataFrame) -> DataFrame:
    """Category of each row; unmapped codes vanish.  The map is a VALUES list."""
    return fact.join(F.broadcast(category_map), "category_code")


def jn_geo_left(fact: DataFrame, geo: DataFrame) -> DataFrame:
    return fact.join(geo, "office", "left")


def sized_scope(fact: DataFrame, category_map: DataFrame, geo: DataFrame) -> DataFrame:
    """Rows that take part in the size rules."""
    dims = category_map.where(
        F.col("category").isin(*SIZE_CATEGORIES) & ~F.col("category_detail").contains(FIRM_DEMAND)
    )
    return jn_geo_left(jn_map_inner(fact, dims), geo)


def agg_ref(fact: DataFrame, category_map: DataFrame, geo: DataFrame, p: SizeParams) -> DataFrame:
    """Median, maximum and months of each account in the reference window."""
    window = flt_account(fact).where(yyyymm("year", "month").between(p.ref_from, p.ref_to))
    monthly = sized_scope(window, category_map, geo).groupBy(
        "account", "category_detail", "region", yyyymm("year", "month").alias("yyyymm")
    ).agg(F.sum("vol_meas_water").alias("vol"))
    # at most one row per month of the window: the exact median is bounded
    return monthly.groupBy("account", "category_detail", "region").agg(
        median("vol").alias("vol_median_ref"),
        F.max("vol").cast("double").alias("vol_max_ref"),
        F.count("*").alias("months_ref"),
    )


def agg_series_total(ref: DataFrame) -> DataFrame:
    return ref.groupBy("category_detail", "region").agg(F.sum("vol_median_ref").alias("vol_series_ref"))


def thresholds(spark: SparkSession, p: SizeParams) -> DataFrame:
    ddl = [("category_detail", "string"), ("share_min", "double"), ("v_min", "double")]
    return relation(spark, ddl, p.thresholds)


def jn_series_using(ref: DataFrame, totals: DataFrame, limits: DataFrame) -> DataFrame:
    """Series total per account (NULL regions drop) and the category's limits."""
    joined = ref.join(totals, ["category_detail", "region"])
    return joined.join(F.broadcast(limits), "category_detail", "left")


def agg_size(ref: DataFrame, totals: DataFrame, limits: DataFrame, p: SizeParams) -> DataFrame:
    """Size class per account x category; no limit means others."""
    share = ratio("vol_median_ref", "vol_series_ref")
    large = (
        (share >= F.col("share_min")) & (F.col("vol_median_ref") >= F.col("v_min"))
        & (F.col("months_ref") >= p.min_months)
    )
    return jn_series_using(ref, totals, limits).select(
        "account", "category_detail", "region", "vol_median_ref", "vol_max_ref", "months_ref", "vol_series_ref",
        share.alias("share_series"),
        F.when(large, LARGE).otherwise(OTHERS).alias("size_class"),
    )


def win_main_cat(sized: DataFrame) -> DataFrame:
    """One row per account: the category of the largest median."""
    w = Window.partitionBy("account").orderBy(F.desc("vol_median_ref"), "category_detail", "region")
    return sized.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def agg_size_summary(size: DataFrame) -> DataFrame:
    large = F.col("size_class") == LARGE
    return size.groupBy("category_detail").agg(
        F.count_if(large).alias("n_large"),
        F.count("*").alias("n_accounts"),
        percent(F.sum(F.when(large, F.col("vol_median_ref"))), F.sum("vol_median_ref"), 1).alias("pct_volume_large"),
    )


# -- absurd volumes ---------------------------------------------------------


def account_months(fact: DataFrame) -> DataFrame:
    return fact.groupBy("account", "year", "month").agg(
        *[F.sum(f"vol_{v}").cast("double").alias(v) for v in VOLUMES]
    )


def agg_absurd_cand(fact: DataFrame, p: AbsurdParams) -> DataFrame:
    """Account-months with some volume at or above the floor."""
    monthly = account_months(flt_account(fact))
    return monthly.where(F.greatest(*VOLUMES) >= p.floor)


def jn_semi_in(fact: DataFrame, cand: DataFrame) -> DataFrame:
    """Whole history of the candidate accounts only."""
    return fact.join(cand.select("account").distinct(), "account", "left_semi")


def agg_absurd_factor(fact: DataFrame, p: AbsurdParams) -> DataFrame:
    """Factor that takes an absurd account-month to the account's median."""
    cand = agg_absurd_cand(fact, p)
    history = account_months(jn_semi_in(flt_account(fact), cand))
    medians = history.groupBy("account").agg(*[median(v).alias(f"median_{v}") for v in VOLUMES])

    def factor(v: str) -> Column:
        vol, med = F.col(v), F.col(f"median_{v}")
        absurd = (vol >= p.floor) & (vol >= p.ratio * F.greatest(med, F.lit(1.0)))
        return F.when(absurd, F.greatest(med, F.lit(0.0)) / vol).otherwise(F.lit(1.0))

    out = cand.join(medians, "account").withColumns({f"f_{v}": factor(v) for v in VOLUMES})
    changed = F.least(*[F.col(f"f_{v}") for v in VOLUMES]) < 1
    return out.where(changed)


def agg_absurd_summary(factors: DataFrame) -> DataFrame:
    removed = [snap_round(F.sum(F.col(v) * (1 - F.col(f"f_{v}"))), 0).alias(f"removed_{v}") for v in VOLUMES]
    return factors.groupBy("year").agg(F.count("*").alias("account_months"), *removed)


def jn_factor(fact: DataFrame, factors: DataFrame) -> DataFrame:
    """Correction factors next to each fact row; 1 where nothing is corrected.

    Rows without an account stay out of the join: they would all meet in one task.
    """
    none = {f"f_{v}": F.lit(1.0) for v in VOLUMES}
    return _factor_of_known(fact.where(has_account()), factors).unionByName(fact.where(~has_account()).withColumns(none))


def _factor_of_known(fact: DataFrame, factors: DataFrame) -> DataFrame:
    """The join is on the account alone, so the bucketed fact stays in its place; an account's few
    absurd months (one entry each) travel as a list, of which a row takes its own month."""
    names = [f"f_{v}" for v in VOLUMES]
    months = factors.groupBy("account").agg(F.collect_list(F.struct("year", "month", *names)).alias("_months"))
    own = F.filter("_months", lambda m: (m["year"] == F.col("year")) & (m["month"] == F.col("month")))
    found = fact.join(months, "account", "left").withColumn("_own", F.get(own, F.lit(0)))
    one = {c: F.coalesce(F.col("_own")[c], F.lit(1.0)) for c in names}
    return found.withColumns(one).drop("_months", "_own")


def jn_large(fact: DataFrame, size: DataFrame) -> DataFrame:
    large = size.where(F.col("size_class") == LARGE).select(
        "account", "vol_median_ref", "vol_max_ref", "months_ref", "share_series"
    )
    return fact.join(large, "account")


# -- aggregated base --------------------------------------------------------

HIST_DIMS = [
    "category_code", "category_name", "category_detail", "category", "size_class", "region", "municipality",
    "ibge_full", "office", "territory", "year", "month",
]
FLAGS = ("water", "sewage", "sewage_real", "sewage_avail")
CORRECTED = {
    "vol_meas_water": "f_meas_water", "vol_meas_sewage": "f_meas_sewage",
    "vol_meas_sewage_real": "f_meas_sewage", "vol_meas_sewage_avail": "f_meas_sewage",
    "vol_bill_water": "f_bill_water", "vol_bill_sewage": "f_bill_sewage",
    "vol_bill_sewage_real": "f_bill_sewage", "vol_bill_sewage_avail": "f_bill_sewage",
}


def agg_hist(
    fact: DataFrame, category_map: DataFrame, geo: DataFrame, size: DataFrame, factors: DataFrame
) -> DataFrame:
    """Base per category x office x territory x size x month.

    Distinct connections come from one row per account (flags kept as maxima),
    so no distinct aggregate multiplies the rows.
    """
    known_rows = fact.where(has_account()).join(size.select("account", "size_class"), "account", "left").withColumn(
        "size_class", F.coalesce("size_class", F.lit(OTHERS))
    )
    known_rows = _factor_of_known(known_rows, factors)
    other_rows = fact.where(~has_account()).withColumns({"size_class": F.lit(OTHERS), **{f"f_{v}": F.lit(1.0) for v in VOLUMES}})
    sums = ["n_bills", "days", "units", *[f"units_{x}" for x in FLAGS]]
    per_row = [
        *[F.max(f"has_{x}").alias(f"has_{x}") for x in FLAGS],
        *[F.sum(c).alias(c) for c in sums],
        *[F.sum(F.col(v).cast("double") * F.col(f)).alias(v) for v, f in CORRECTED.items()],
        F.sum("vol_meas_water").cast("double").alias("vol_meas_water_raw"),
        F.sum("vol_bill_water").cast("double").alias("vol_bill_water_raw"),
    ]
    one = ["account", "category_code", "size_class", "office", "territory", "year", "month"]
    # real accounts are grouped in their buckets; the others are dealt out by all their keys
    per_account = known_rows.groupBy(*one).agg(*per_row).unionByName(other_rows.groupBy(*one).agg(*per_row))
    known = F.col("account").isNotNull()
    keys = ["category_code", "size_class", "office", "territory", "year", "month"]
    grouped = per_account.groupBy(*keys).agg(
        F.count("account").alias("conns"),
        *[F.sum(F.when(known & (F.col(f"has_{x}") == 1), 1).otherwise(0)).alias(f"conns_{x}") for x in FLAGS],
        *[F.sum(c).alias(c) for c in [*sums, *CORRECTED, "vol_meas_water_raw", "vol_bill_water_raw"]],
    )
    # dimensions join after the sums: a few rows instead of the whole fact
    geo1 = geo.select("office", "region", "municipality", "ibge_full")
    out = jn_geo_left(jn_map_inner(grouped, category_map), geo1)
    return out.select(*HIST_DIMS, *[c for c in out.columns if c not in HIST_DIMS])


def prj_large_detail(
    fact: DataFrame, category_map: DataFrame, geo: DataFrame, size: DataFrame, factors: DataFrame
) -> DataFrame:
    """Account x month detail of the large accounts with corrected volumes."""
    rows = jn_geo_left(jn_map_inner(jn_factor(jn_large(fact, size), factors), category_map), geo)
    return rows.select(
        "account", "category_code", "category_detail", "category", "region", "municipality", "ibge_full", "office",
        "territory", "year", "month", "vol_median_ref", "vol_max_ref", "months_ref", "share_series", "days",
        "units_water", "units_sewage",
        *[(F.col(f"vol_{v}").cast("double") * F.col(f"f_{v}")).alias(f"vol_{v}") for v in VOLUMES],
    )

"""Data-quality reports D1-D7 and C1-C5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions.dates import first_of_month, shift, yyyymm
from ..functions.numeric import median, percent, ratio, snap_round
from ..functions.windows import over_time, rank_by_cells
from ..params import AbsurdParams, BaseParams, SizeParams
from ..rules import EXCLUDED_DETAILS, MULTI_BILL_TYPES, OFFICE_DUPLICATE, OFFICE_UNKNOWN
from ..schemas import SERIES
from ..sources.values import relation
from .accounts import sized_scope
from .facts import flt_account

MONTH = ["account", "year", "month"]


def dq_d1(fact: DataFrame) -> DataFrame:
    """Fact rows with more than one bill, and their volume, per month."""
    many = F.col("n_bills") > 1
    return fact.groupBy("year", "month").agg(
        F.count_if(many).alias("rows_multi"),
        percent(F.count_if(many), F.count("*"), 2).alias("pct_rows"),
        percent(F.sum(F.when(many, F.col("vol_meas_water"))), F.sum("vol_meas_water"), 2).alias("pct_volume"),
    )


def multi_bills(clean: DataFrame, fact: DataFrame) -> DataFrame:
    """Deduplicated bills of the account-months that have several."""
    multi = fact.where(F.col("n_bills") > 1).select(*MONTH).distinct()
    return clean.join(multi, MONTH, "left_semi")


def _billed() -> Column:
    return F.col("bill_water_pos") + F.col("bill_water_neg")


def _credit() -> Column:
    return F.when(_billed() < 0, 1).otherwise(0)


def win_bill_order(rows: DataFrame) -> DataFrame:
    """Bills (``multi_bills``) of an account-month, credits last, then newest first.

    The order is counted inside (credit, issue day) cells, so an account-month
    with very many bills is split over tasks.
    """
    newest = -F.unix_date("issue_date")
    ties = [F.desc("contract"), F.desc("meas_water")]
    return rank_by_cells(rows, MONTH, [_credit(), newest], ties, "bill_order")


def dq_d1b(rows: DataFrame) -> DataFrame:
    """What the account-months with several bills (``multi_bills``) are."""
    # the first bill of the order above, as an aggregate: no ranking needed
    place = F.struct(1 - _credit(), "issue_date", "contract", "meas_water")
    per = rows.groupBy(*MONTH).agg(
        F.count("*").alias("n"),
        F.sum("days").alias("days_total"),
        F.max("days").alias("days_max"),
        F.sum("meas_water").alias("vol_sum"),
        F.max_by("meas_water", place).alias("vol_last"),
        F.sum(_billed()).alias("vol_bill"),
        F.sum("bill_water_neg").alias("vol_neg"),
        F.count_if((_billed() < 0) | (F.col("bill_water_neg") < 0)).alias("n_credits"),
    )
    kind = (
        F.when(F.col("n_credits") > 0, MULTI_BILL_TYPES[0])
        .when(F.col("days_total") * 5 <= F.col("days_max") * 6, MULTI_BILL_TYPES[1])
        .when(F.col("days_total").between(25, 40), MULTI_BILL_TYPES[2])
        .otherwise(MULTI_BILL_TYPES[3])
    )
    return per.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("account_months"),
        F.sum("n").alias("bills"),
        *[F.sum(c).alias(c) for c in ("vol_sum", "vol_last", "vol_bill", "vol_neg")],
    )


def top_n(fact: DataFrame, n: int) -> DataFrame:
    """The n largest account-months among those with several bills."""
    g = fact.where(F.col("n_bills") > 1).groupBy(*MONTH).agg(F.sum("vol_meas_water").alias("vol_account_month"))
    return g.orderBy(F.desc_nulls_last("vol_account_month"), *MONTH).limit(n)


def jn_topk_back(top: DataFrame, bills: DataFrame) -> DataFrame:
    """Bills of the top account-months; the top list has n rows."""
    shown = ["office", "contract", "issue_date", "days", "units", "meas_water", "bill_water_pos", "bill_water_neg"]
    rows = bills.where(F.col("processed") == "S").join(F.broadcast(top), MONTH)
    return rows.select("vol_account_month", *MONTH, *shown).distinct()


def dq_d1c(fact: DataFrame, bills: DataFrame, n: int) -> DataFrame:
    rows = jn_topk_back(top_n(fact, n), bills)
    return rows.orderBy(F.desc("vol_account_month"), "account", "issue_date")


def jn_anti_cat(fact: DataFrame, category_map: DataFrame) -> DataFrame:
    """Rows whose code has no category; rows without a code stay."""
    return fact.join(F.broadcast(category_map), "category_code", "left_anti")


def dq_d2(fact: DataFrame, category_map: DataFrame) -> DataFrame:
    return jn_anti_cat(fact, category_map).groupBy("category_code", "item_code").agg(
        F.count("*").alias("n_rows"), F.sum("vol_meas_water").alias("vol_meas_water")
    )


def jn_anti_geo(fact: DataFrame, geo: DataFrame) -> DataFrame:
    return fact.join(geo, "office", "left_anti")


def dq_d3(fact: DataFrame, geo: DataFrame) -> DataFrame:
    """Offices unknown to the geography, or listed more than once."""
    unknown = jn_anti_geo(fact, geo).groupBy("office").agg(F.sum("vol_meas_water").cast("double").alias("value"))
    twice = geo.groupBy("office").agg(F.count("*").cast("double").alias("value")).where("value > 1")
    return unknown.withColumn("problem", F.lit(OFFICE_UNKNOWN)).unionByName(
        twice.withColumn("problem", F.lit(OFFICE_DUPLICATE))
    )


def src_grid(spark: SparkSession, p: SizeParams) -> DataFrame:
    """Candidate thresholds: every share with every volume, and their ranks."""
    shares = relation(spark, [("i", "int"), ("share_min", "double")], list(enumerate(p.grid_share, 1)))
    volumes = relation(spark, [("j", "int"), ("v_min", "double")], list(enumerate(p.grid_volume, 1)))
    return shares.crossJoin(volumes)


def dq_d4(
    fact: DataFrame, category_map: DataFrame, geo: DataFrame, size: DataFrame, grid: DataFrame, p: SizeParams
) -> DataFrame:
    """Out-of-sample calibration of the size thresholds.

    An account passes a threshold if it passes every smaller one, so accounts
    fold to (series, thresholds passed) before they meet the grid.
    """
    y0, y1 = p.eval_year, p.eval_year + 1
    rows = fact.where((F.col("month") <= p.eval_last_month) & F.col("year").isin(y0, y1))
    v = F.col("vol_meas_water")
    acc = sized_scope(rows, category_map, geo).groupBy("account", "category_detail", "region").agg(
        F.sum(F.when(F.col("year") == y0, v).otherwise(0)).cast("double").alias("v0"),
        F.sum(F.when(F.col("year") == y1, v).otherwise(0)).cast("double").alias("v1"),
    )
    ref = size.select("account", "category_detail", "region", "share_series", "vol_median_ref", "months_ref")
    joined = acc.join(ref, ["account", "category_detail", "region"], "left")
    share, med = F.coalesce("share_series", F.lit(0.0)), F.coalesce("vol_median_ref", F.lit(0.0))
    enough = F.coalesce("months_ref", F.lit(0)) >= p.min_months

    def passed(x: Column, limits) -> Column:
        return F.when(enough, sum((x >= F.lit(t)).cast("int") for t in limits)).otherwise(0)

    cells = joined.groupBy(
        "category_detail", "region",
        passed(share, p.grid_share).alias("si"), passed(med, p.grid_volume).alias("vj"),
    ).agg(F.sum("v0").alias("v0"), F.sum("v1").alias("v1"))
    large = (F.col("si") >= F.col("i")) & (F.col("vj") >= F.col("j"))
    series = cells.crossJoin(F.broadcast(grid)).groupBy(
        "category_detail", "region", "share_min", "v_min", large.alias("large")
    ).agg(F.sum("v0").alias("v0"), F.sum("v1").alias("v1"))
    move, big, small = F.abs(F.col("v1") - F.col("v0")), F.col("large"), ~F.col("large")
    return series.groupBy("category_detail", "share_min", "v_min").agg(
        percent(F.sum(F.when(big, F.col("v0"))), F.sum("v0"), 1).alias("pct_volume_large"),
        percent(F.sum(F.when(big, move)), F.sum(F.when(big, F.col("v0"))), 2).alias("var_abs_large"),
        percent(F.sum(F.when(small, move)), F.sum(F.when(small, F.col("v0"))), 2).alias("var_abs_others"),
        percent(F.sum(F.when(big, move)), F.sum(move), 1).alias("pct_var_large"),
    )


def _totals(hist: DataFrame, tag: str, raw: bool) -> DataFrame:
    cols = ["vol_meas_water", "vol_bill_water", "units_water"] + (["vol_meas_water_raw"] if raw else [])
    return hist.groupBy("year", "month", "category").agg(*[F.sum(c).alias(f"{tag}_{c}") for c in cols])


def jn_full(new: DataFrame, old: DataFrame) -> DataFrame:
    """New and old totals by month and category, kept on either side."""
    return _totals(new, "new", True).join(_totals(old, "old", False), ["year", "month", "category"], "full")


def dq_d5(new: DataFrame, old: DataFrame) -> DataFrame:
    def change(a: str, b: str) -> Column:
        return snap_round(100 * (ratio(a, b) - 1), 3)

    return jn_full(new, old).select(
        "year", "month", "category",
        snap_round("old_vol_meas_water", 4).alias("vol_meas_before"),
        snap_round("new_vol_meas_water", 4).alias("vol_meas_new"),
        change("new_vol_meas_water", "old_vol_meas_water").alias("pct_change_meas"),
        change("new_vol_meas_water_raw", "old_vol_meas_water").alias("pct_change_meas_raw"),
        snap_round("old_vol_bill_water", 4).alias("vol_bill_before"),
        snap_round("new_vol_bill_water", 4).alias("vol_bill_new"),
        change("new_vol_bill_water", "old_vol_bill_water").alias("pct_change_bill"),
        F.col("old_units_water").alias("units_before"),
        F.col("new_units_water").alias("units_new"),
    )


def dq_d6(fact: DataFrame, p: AbsurdParams) -> DataFrame:
    """Absurd account-months of measured water, worst first."""
    known = flt_account(fact)
    cand = known.groupBy(*MONTH).agg(
        F.sum("vol_meas_water").cast("double").alias("vol"),
        F.sum("vol_bill_water").cast("double").alias("vol_bill"),
        F.max("office").alias("office"),
        F.max("category_code").alias("category_code"),
        F.max("units_water").alias("units"),
        F.sum("n_bills").alias("bills"),
    ).where(F.col("vol") >= p.floor)
    hist = known.join(cand.select("account").distinct(), "account", "left_semi").groupBy(*MONTH).agg(
        F.sum("vol_meas_water").cast("double").alias("v")
    )
    med = hist.groupBy("account").agg(median("v").alias("median"), F.count("*").alias("months"))
    total = fact.groupBy("year", "month").agg(F.sum("vol_meas_water").cast("double").alias("total"))
    one = F.greatest(F.col("median"), F.lit(1.0))
    excess = F.col("vol") - F.col("median")
    rows = cand.join(med, "account").where(F.col("vol") >= p.ratio * one).join(total, ["year", "month"])
    return rows.select(
        "year", "month", "account", "office", "category_code", "units", "bills",
        snap_round("vol", 4).alias("vol"), snap_round("vol_bill", 4).alias("vol_bill"),
        snap_round("median", 4).alias("median"), "months",
        snap_round(F.col("vol") / one, 1).alias("ratio_median"),
        snap_round(excess, 4).alias("excess"),
        percent(excess, "total", 2).alias("pct_excess_month"),
    ).orderBy(F.desc("excess"))


def _cycle_months(fact: DataFrame, p: BaseParams) -> DataFrame:
    rows = flt_account(fact).where(yyyymm("year", "month").between(p.cycle_from, p.cycle_to))
    return rows.groupBy("account", first_of_month("year", "month").alias("period")).agg(
        F.sum("n_bills").alias("bills"),
        F.max("days").alias("days"),
        F.sum("vol_meas_water").cast("double").alias("vol"),
        F.sum("vol_bill_water").cast("double").alias("vol_bill"),
    )


def dq_d7a(fact: DataFrame, p: BaseParams) -> DataFrame:
    """Bills per account and billed days, by month.

    Accounts fold to (month, days) before the median, which then weighs each
    number of days by its accounts.
    """
    m = _cycle_months(fact, p)
    unread = (F.col("vol") == 0) & (F.col("vol_bill") > 0)
    cells = m.groupBy("period", "days").agg(
        F.count("*").alias("n"),
        F.sum("vol").alias("vol"),
        F.count_if(F.col("bills") > 1).alias("multi"),
        F.count_if(unread).alias("unread"),
    )
    long = F.col("days") > 45
    n = F.sum("n")
    return cells.groupBy("period").agg(
        n.alias("accounts"),
        snap_round(F.sum("vol"), 0).alias("vol_meas"),
        F.percentile("days", F.lit(0.5), F.col("n")).alias("days_median"),
        percent(F.sum("multi"), n, 2).alias("pct_two_bills"),
        percent(F.sum(F.when(long, F.col("n")).otherwise(0)), n, 2).alias("pct_over_45_days"),
        percent(F.sum(F.when(long, F.col("vol"))), F.sum("vol"), 2).alias("pct_vol_over_45_days"),
        percent(F.sum("unread"), n, 2).alias("pct_unread"),
    )


def jn_hole(months: DataFrame) -> DataFrame:
    """Months missing between two billed ones.

    The next billed month of an account is two months ahead exactly when one
    month is missing, so one ordered pass replaces the self joins.
    """
    w = over_time(["account"])
    ahead = {c: F.lead(c).over(w).alias(f"next_{c}") for c in ("period", "vol", "bills", "days")}
    rows = months.select("account", "period", F.col("vol").alias("vol_before"), *ahead.values())
    return rows.where(F.col("next_period") == shift("period", 2)).select(
        "account", shift("period", 1).alias("hole_month"), "vol_before",
        F.col("next_vol").alias("vol_after"), F.col("next_bills").alias("bills_after"),
        F.col("next_days").alias("days_after"),
    )


def account_holes(fact: DataFrame, p: BaseParams) -> DataFrame:
    return jn_hole(_cycle_months(fact, p))


def dq_d7b(fact: DataFrame, p: BaseParams) -> DataFrame:
    cells = account_holes(fact, p).groupBy("hole_month", "days_after").agg(
        F.count("*").alias("n"), F.sum("vol_before").alias("vb"), F.sum("vol_after").alias("va"),
        F.sum("bills_after").alias("fa"),
    )
    n = F.sum("n")
    return cells.groupBy("hole_month").agg(
        n.alias("accounts"),
        snap_round(F.sum("vb"), 0).alias("vol_month_before"),
        snap_round(ratio(F.sum("va"), F.sum("vb")), 2).alias("ratio_next_before"),
        snap_round(ratio(F.sum("fa"), n), 2).alias("bills_next_month"),
        F.percentile("days_after", F.lit(0.5), F.col("n")).alias("days_next_median"),
        percent(F.sum(F.when(F.col("days_after") > 45, F.col("n")).otherwise(0)), n, 1).alias("pct_long_bill"),
    )


def dq_c1(hist: DataFrame, stage1: DataFrame, stats: DataFrame, base: DataFrame) -> DataFrame:
    """Where the measured volume goes, month by month."""
    v = F.col("vol_meas_water")
    h = hist.groupBy(first_of_month("year", "month").alias("period")).agg(
        F.sum(v).alias("total"),
        F.sum(F.when(F.col("category_detail").isin(*EXCLUDED_DETAILS), v).otherwise(0)).alias("excluded"),
    )
    e1 = stage1.join(stats.select(*SERIES, "reason"), SERIES).groupBy("period").agg(
        F.sum(v).alias("stage1"),
        F.sum("vol_meas_water_imputed").alias("imputed"),
        F.sum(F.when(F.col("reason").isNotNull(), v).otherwise(0)).alias("invalid"),
    )
    fin = base.groupBy("period").agg(F.sum(v).alias("final"))
    return h.join(e1, "period").join(fin, "period", "left").select(
        "period",
        snap_round("total", 0).alias("total"),
        percent("excluded", "total", 2).alias("pct_excluded"),
        percent("invalid", "total", 3).alias("pct_invalid"),
        percent("imputed", "total", 3).alias("pct_imputed"),
        snap_round(F.col("total") - F.col("excluded") - F.col("stage1"), 0).alias("diff_stage1"),
        snap_round("final", 0).alias("final"),
    )


def dq_c2(base: DataFrame) -> DataFrame:
    """Repeated series x size x month (none expected)."""
    return base.groupBy("series_key", "size_class", "period").agg(F.count("*").alias("n")).where("n > 1")


def dq_c3(base: DataFrame) -> DataFrame:
    """Months with a missing covariate."""
    cols = ("prec_tot", "temp_med", "jobs", "real_tariff", "abc_class")
    missing = [F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in cols]
    g = base.groupBy("period").agg(F.count("*").alias("n_rows"), *missing)
    return g.where(sum(F.col(f"no_{c}") for c in cols) > 0)


def dq_c4(valid: DataFrame, base: DataFrame, first, last) -> DataFrame:
    """Volumes and units around the two-month window, before and after."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        rows = df.where(F.col("period").between(F.lit(first), F.lit(last)))
        return rows.groupBy("category_detail", "period").agg(
            F.sum("vol_meas_water").alias(f"vol_{tag}"), F.sum("units_water").alias(f"units_{tag}")
        )

    j = side(valid, "before").join(side(base, "after"), ["category_detail", "period"])
    return j.select(
        "category_detail", "period",
        *[snap_round(c, 0).alias(c) for c in ("vol_before", "vol_after", "units_before", "units_after")],
        snap_round(ratio("vol_after", "units_after"), 2).alias("consumption"),
    )


def dq_c5(old: DataFrame, new: DataFrame) -> DataFrame:
    """New base against an older file, by category and month."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("category_detail", F.col("period").cast("date").alias("period")).agg(
            F.sum("vol_meas_water").alias(f"vol_{tag}"), F.sum("units_water").alias(f"units_{tag}")
        )

    j = side(old, "old").join(side(new, "new"), ["category_detail", "period"], "full")
    return j.select(
        "category_detail", "period",
        snap_round(100 * (ratio("vol_new", "vol_old") - 1), 2).alias("pct_change_volume"),
        snap_round(100 * (ratio("units_new", "units_old") - 1), 2).alias("pct_change_units"),
    )

"""Covariates: price index, tariff, climate, jobs, and the analytic base."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions.numeric import product, ratio, snap_round
from ..functions.text import series_key
from ..functions.windows import UP_TO_NOW, carry_forward, over_time
from ..params import BaseParams, CovariateParams, TariffParams
from ..sources.values import relation


def win_cumprod(index: DataFrame) -> DataFrame:
    """Index = 100 x running product of (1 + monthly / 100).  One row per month
    of calendar, so the single ordered window stays small."""
    w = Window.partitionBy(F.lit(0)).orderBy("period").rowsBetween(*UP_TO_NOW)
    level = 100 * F.exp(F.sum(F.ln(1 + F.col("value") / 100)).over(w))
    return index.select("period", F.col("value").alias("monthly"), level.alias("index"))


def adjustments(spark: SparkSession, p: TariffParams) -> DataFrame:
    ddl = [("bill_month", "date"), ("valid_from", "date"), ("category_detail", "string"), ("percent", "double")]
    return relation(spark, ddl, p.adjustments)


def details(spark: SparkSession, p: TariffParams) -> DataFrame:
    return relation(spark, [("category_detail", "string")], [(d,) for d in p.details])


def agg_expand_all(adj: DataFrame, cats: DataFrame) -> DataFrame:
    """An adjustment without a category becomes one row per category."""
    cols = ["bill_month", "category_detail", "percent"]
    own = adj.where(F.col("category_detail").isNotNull()).select(*cols)
    every = adj.where(F.col("category_detail").isNull()).drop("category_detail").crossJoin(F.broadcast(cats))
    return own.unionByName(every.select(*cols))


def agg_tariff(adj: DataFrame, cats: DataFrame, index: DataFrame, p: TariffParams) -> DataFrame:
    """Real tariff per category x month, 100 at the base month.

    The nominal index is the product of the month's adjustments, accumulated;
    a missing price index repeats the last one and is flagged.
    """
    growth = F.greatest(1 + F.col("percent") / 100, F.lit(1e-12))
    steps = agg_expand_all(adj, cats).groupBy("category_detail", F.col("bill_month").alias("period")).agg(
        product(growth).alias("step")
    )
    months = F.explode(F.sequence(F.lit(p.base_month), F.lit(p.last_month), F.expr("interval 1 month")))
    grid = cats.select("category_detail", months.alias("period"))
    w = over_time(["category_detail"])
    nominal = F.exp(F.sum(F.ln(F.coalesce("step", F.lit(1.0)))).over(w.rowsBetween(*UP_TO_NOW)))
    rows = grid.join(steps, ["category_detail", "period"], "left").join(
        F.broadcast(index.select("period", "index")), "period", "left"
    )
    rows = rows.withColumn("nominal", nominal).withColumn("estimated", F.col("index").isNull())
    rows = rows.withColumn("index", carry_forward("index", w))
    first = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    real = (
        F.lit(100.0) * F.col("nominal") / F.first("nominal").over(first)
        * F.first("index").over(first) / F.col("index")
    )
    return rows.withColumn("real_tariff", real).select(
        "category_detail", "period", "nominal", "index", "estimated", "real_tariff"
    )


def agg_climate_month(daily: DataFrame, names: dict[str, str], p: CovariateParams) -> DataFrame:
    """Monthly means of daily readings; a month needs 90 % of its days, counted
    on the variable with the fewest, and the current month never enters."""
    month = F.trunc("day", "month").cast("date")
    agg = daily.groupBy("ibge_code", month.alias("period")).agg(
        *[F.avg(v).alias(n) for v, n in names.items()], *[F.count(v).alias(f"n_{n}") for v, n in names.items()]
    )
    counts = [F.col(f"n_{n}") for n in names.values()]
    valid = F.least(*counts) if len(counts) > 1 else counts[0]
    need = F.ceil(F.lit(p.min_coverage) * F.dayofmonth(F.last_day("period")))
    return (
        agg.withColumn("valid_days", valid)
        .where((F.col("valid_days") >= need) & (F.col("period") < F.lit(p.current_month)))
        .select("ibge_code", "period", *names.values(), "valid_days")
    )


def prj_jobs_scope(jobs: DataFrame, served: DataFrame, p: CovariateParams) -> DataFrame:
    """One state, served municipalities only."""
    rows = jobs.where(F.col("uf") == p.state)
    return rows.join(served, "ibge_code").select("ibge_code", "municipality", "period", "stock")


def dq_jobs(jobs: DataFrame, p: CovariateParams) -> DataFrame:
    """Share of cells where the stock moves by the balance, and the gate on it."""
    w = over_time(["ibge_code"])
    step = F.col("stock") - F.lag("stock").over(w)
    ok = F.abs(step - F.col("balance")) <= 1
    checked = jobs.select(ok.alias("ok"))
    cell = F.when(F.col("ok"), 1.0).when(~F.col("ok"), 0.0)
    return checked.agg(F.count("ok").alias("cells"), snap_round(F.avg(cell), 4).alias("share_ok")).withColumn(
        "aligned", F.col("share_ok") >= p.min_alignment
    )


def jn_calendar(keys: DataFrame, last: DataFrame, values: DataFrame, p: BaseParams) -> DataFrame:
    """Municipality x month grid with the known values."""
    months = F.explode(F.sequence(F.lit(p.calendar_start), F.col("last"), F.expr("interval 1 month")))
    grid = keys.crossJoin(F.broadcast(last)).select("ibge_code", months.alias("period"))
    return grid.join(values, ["ibge_code", "period"], "left")


def win_locf(grid: DataFrame) -> DataFrame:
    """Last known stock, carried inside each municipality."""
    return grid.select("ibge_code", "period", carry_forward("stock", over_time(["ibge_code"])).alias("jobs"))


def prj_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("series_key", series_key("region", "municipality", "office", "category_detail", "territory"))


def jn_cov(stage4: DataFrame, abc: DataFrame, climate: DataFrame, jobs: DataFrame, tariff: DataFrame) -> DataFrame:
    """Analytic base: series months with ABC class and covariates."""
    rows = (
        prj_key(stage4)
        .join(abc.select("municipality", "abc_class"), "municipality", "left")
        .join(climate.select("ibge_code", "period", "prec_tot", "temp_med"), ["ibge_code", "period"], "left")
        .join(jobs, ["ibge_code", "period"], "left")
        .join(tariff.select("category_detail", "period", "real_tariff"), ["category_detail", "period"], "left")
    )
    first = ["series_key", "region", "municipality", "ibge_code", "office", "category", "category_detail", "territory",
             "size_class", "abc_class", "period"]
    return rows.select(*first, *[c for c in rows.columns if c not in first])


def dq_compare(old: DataFrame, new: DataFrame, keys: list[str], cols: list[str], table: str) -> DataFrame:
    """Old against new covariate on the common keys, one row per column."""
    o = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in cols])
    n = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in cols])
    j = o.join(n, keys)
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"old_{c}").alias("a"), F.col(f"new_{c}").alias("b")) for c in cols])
    )
    flat = j.select(cells.alias("c")).select("c.*")
    diff = F.abs(F.col("b") - F.col("a"))
    return flat.groupBy("variable").agg(
        F.lit(table).alias("table"),
        F.count("*").alias("common_keys"),
        F.avg(diff).alias("mean_diff"),
        F.max(diff).alias("max_diff"),
        F.corr("a", "b").alias("corr"),
    )


def dq_range(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, t in tables.items():
        row = t.agg(F.min("period").alias("first"), F.max("period").alias("last"), F.count("*").alias("n")).select(
            F.lit(name).alias("table"), "first", "last", "n"
        )
        out = row if out is None else out.unionByName(row)
    return out


def dq_failrate(results: DataFrame, failed: Column, p: CovariateParams) -> DataFrame:
    """Gate before a write: at most 5 % of the points may fail.

    ``PublishedTable.upsert`` takes its audit from here (``failing_points``): a batch beyond the share is staged and not published.
    """
    return results.agg(
        F.count("*").alias("points"), F.count_if(failed).alias("failures")
    ).withColumn("may_write", F.col("failures") <= F.lit(p.max_fail_rate) * F.greatest(F.col("points"), F.lit(1)))


def failing_points(point: str, readings: Column, least: int, p: CovariateParams) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Audit of staged rows: of the batch's points, those that now have fewer than ``least`` readings fail."""

    def audit(staged: DataFrame, batch: DataFrame) -> DataFrame:
        of_batch = staged.join(batch.select(point).distinct(), point, "left_semi")
        return dq_failrate(of_batch.groupBy(point).agg(F.count(readings).alias("_n")), F.col("_n") < least, p)

    return audit

"""The stages of the monthly run, as the registered queries use them."""

from __future__ import annotations

import functools
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

from metermill.operators import accounts, facts, quality
from metermill.plans.shipping import ship
from metermill.plans.workspace import Workspace
from metermill.sources import driver_tables as src


def bills(ws: Workspace) -> DataFrame:
    return src.bills(ws.spark, ws.source)


def bill_rows(ws: Workspace) -> int:
    return src.bill_rows(ws.spark, ws.source)


def clean_bills(ws: Workspace) -> DataFrame:
    """Processed bills without exact copies: the joins and the DISTINCT of a run happen here, once."""
    return ws.stage("clean_bills", lambda: facts.prj_dedup(bills(ws)), rows=lambda: bill_rows(ws))


def multi_bills(ws: Workspace) -> DataFrame:
    return ws.stage("multi_bills", lambda: quality.multi_bills(clean_bills(ws), fact(ws)), rows=lambda: bill_rows(ws))


def registry(ws: Workspace) -> DataFrame:
    return src.registry(ws.spark, ws.source)


def cmap(ws: Workspace) -> DataFrame:
    return src.category_map(ws.spark)


def geo(ws: Workspace) -> DataFrame:
    return src.geo_map(ws.spark, ws.source)


def latest(ws: Workspace) -> DataFrame:
    return facts.win_latest(registry(ws))


def fact(ws: Workspace) -> DataFrame:
    return ws.stage(
        "fact",
        lambda: facts.fact_by_account(clean_bills(ws), latest(ws)),
        bucket_by="account",
        rows=lambda: bill_rows(ws),
        long_rules=True,
    )


def ref(ws: Workspace) -> DataFrame:
    return ws.stage("ref", lambda: accounts.agg_ref(fact(ws), cmap(ws), geo(ws), ws.params.size))


def sized(ws: Workspace) -> DataFrame:
    r, p = ref(ws), ws.params.size
    return accounts.agg_size(r, accounts.agg_series_total(r), accounts.thresholds(ws.spark, p), p)


def size(ws: Workspace) -> DataFrame:
    return ws.stage("size", lambda: accounts.win_main_cat(sized(ws)))


def factors(ws: Workspace) -> DataFrame:
    return ws.stage("factors", lambda: accounts.agg_absurd_factor(fact(ws), ws.params.absurd))


def hist(ws: Workspace) -> DataFrame:
    return ws.stage("hist", lambda: accounts.agg_hist(fact(ws), cmap(ws), geo(ws), size(ws), factors(ws)))


# -- series -----------------------------------------------------------------

from metermill.operators import covariates, rebalance, territory  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def overrides(ws: Workspace) -> DataFrame:
    return territory.override_table(ws.spark, ws.params.base)


def stage1(ws: Workspace) -> DataFrame:
    return ws.stage("stage1", lambda: territory.agg_series_month(hist(ws), overrides(ws), ws.params.base))


def mun_volume(ws: Workspace) -> DataFrame:
    return territory.agg_municipality_12m(stage1(ws), ws.params.base)


def abc(ws: Workspace) -> DataFrame:
    return ws.stage("abc", lambda: territory.prj_abc(mun_volume(ws), ws.params.base))


def stats(ws: Workspace) -> DataFrame:
    return ws.stage("stats", lambda: territory.agg_series_stats(stage1(ws), ws.params.base))


def valid(ws: Workspace) -> DataFrame:
    return territory.rb_valid(stage1(ws), stats(ws))


def joined8(ws: Workspace) -> DataFrame:
    p, v = ws.params.base, valid(ws)
    return rebalance.jn_using8(
        rebalance.agg_bimester(v, p), rebalance.rb_share(v, p), rebalance.agg_neighbours(v, p), p
    )


def stage4(ws: Workspace) -> DataFrame:
    return ws.stage("stage4", lambda: rebalance.rebalance(valid(ws), ws.params.base))


def order_months(ws: Workspace) -> DataFrame:
    return ws.stage("order_months", lambda: src.order_months(ws.spark, ws.source), rows=lambda: bill_rows(ws))


def climate(ws: Workspace) -> DataFrame:
    return ws.stage("climate", lambda: src.climate_monthly(order_months(ws)))


def jobs(ws: Workspace) -> DataFrame:
    return ws.stage("jobs", lambda: src.jobs_monthly(ws.spark, ws.source))


def price_index(ws: Workspace) -> DataFrame:
    return ws.stage("price_index", lambda: src.price_index_monthly(order_months(ws)))


def jobs_filled(ws: Workspace) -> DataFrame:
    b = stage4(ws)
    grid = covariates.jn_calendar(
        b.select("ibge_code").distinct(), territory.last_period(b), jobs(ws), ws.params.base
    )
    return covariates.win_locf(grid)


def tariff(ws: Workspace) -> DataFrame:
    p = ws.params.tariff
    return covariates.agg_tariff(
        covariates.adjustments(ws.spark, p), covariates.details(ws.spark, p),
        covariates.win_cumprod(price_index(ws)), p,
    )


def base(ws: Workspace) -> DataFrame:
    ws = ws.whole  # one base for all segments
    return ws.stage("base", lambda: covariates.jn_cov(stage4(ws), abc(ws), climate(ws), jobs_filled(ws), tariff(ws)))


# -- model series -----------------------------------------------------------

from metermill.operators import forecast as fcs  # noqa: E402
from metermill.operators import series  # noqa: E402


def train_end(ws: Workspace):
    return fcs.shift_date(ws.params.backtest.cut, -1)


def test_end(ws: Workspace):
    return fcs.shift_date(ws.params.backtest.cut, ws.params.backtest.horizon - 1)


def mbase(ws: Workspace) -> DataFrame:
    return ws.stage("mbase", lambda: series.model_base(base(ws), ws.params.backtest, ws.params.grouping))


def exog(ws: Workspace) -> DataFrame:
    return ws.stage("exog", lambda: series.ts_exog_fill(mbase(ws)))


def key_rows(ws: Workspace, target: str | None = None) -> DataFrame:
    """Series of a target cleaned on the training window."""
    target = target or ws.params.backtest.target
    b = ws.params.backtest
    return ws.stage(
        f"keys_{target}",
        lambda: series.ts_key_prep(mbase(ws), target, train_end(ws), b.treat_outliers, b.clean_units),
    )


def peaked(ws: Workspace, target: str | None = None) -> DataFrame:
    target = target or ws.params.backtest.target
    b = ws.params.backtest
    return series.ts_peaks(key_rows(ws, target), train_end(ws), b.peak_factor, b.peak_months)


def grouped(ws: Workspace, target: str | None = None) -> DataFrame:
    target = target or ws.params.backtest.target
    b = ws.params.backtest
    return series.prj_grouping(peaked(ws, target), b.groupings, ws.params.grouping)


def ts(ws: Workspace, target: str | None = None) -> DataFrame:
    target = target or ws.params.backtest.target
    return ws.stage(f"ts_{target}", lambda: series.ts_group(grouped(ws, target), exog(ws)))


def info(ws: Workspace, target: str | None = None) -> DataFrame:
    target = target or ws.params.backtest.target
    return ws.stage(
        f"info_{target}", lambda: series.agg_series_info(ts(ws, target), train_end(ws), ws.params.backtest.min_obs)
    )


def test_rows(ws: Workspace) -> DataFrame:
    first, last = ws.params.backtest.cut, test_end(ws)
    return ts(ws).where(F.col("period").between(F.lit(first), F.lit(last)) & ~F.col("filled"))


def test_grid(ws: Workspace) -> DataFrame:
    return test_rows(ws).select(*series.GROUPED, "period")


def scenarios(ws: Workspace) -> DataFrame:
    """Realised and ex-ante scenarios of the test months."""

    def make():
        real = fcs.sc_realized(ts(ws), ws.params.backtest.cut, test_end(ws))
        ante = fcs.sc_exante(ts(ws), real.select(*series.GROUPED, "period"), train_end(ws))
        return real.unionByName(ante)

    return ws.stage("scenarios", make)


# -- segments and targets ---------------------------------------------------

SIDE_BY_SIDE = 4


def parts(ws: Workspace, targets: tuple[str, ...]) -> list[Workspace]:
    """One workspace per segment x target."""
    return [ws.part(ws.params.part(s, t)) for s in ws.params.segments for t in targets]


def over_parts(ws: Workspace, make: Callable[[Workspace], DataFrame], targets: tuple[str, ...]) -> DataFrame:
    """Rows of every segment x target, which are the first columns."""

    def named(p: Workspace) -> DataFrame:
        b = p.params.backtest
        return make(p).select(F.lit(b.segment).alias("segment"), F.lit(b.target).alias("target"), "*")

    return functools.reduce(DataFrame.unionByName, each_part(ws, named, targets))


def each_part(ws: Workspace, make: Callable[[Workspace], DataFrame], targets: tuple[str, ...]) -> list[DataFrame]:
    """``make`` of every segment x target; their small jobs run side by side."""
    base(ws)
    ship(ws.spark)
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        return list(pool.map(make, parts(ws, targets)))

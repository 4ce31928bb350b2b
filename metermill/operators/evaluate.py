"""Backtest cells, accuracy, selection and the decision."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions.numeric import exact_quantiles, median, ratio, snap_round
from ..functions.text import normalise_name
from ..params import BacktestParams
from ..rules import (
    ACCURACY_LEVELS, BENCHMARKS, CHOSEN, COMBINED, DRIFTLESS, EXTERNAL, EXTERNAL_CAPITAL, EXTERNAL_REGIONS,
    SOCIAL_PREFIX, VOLUME_MODELS,
)
from .reports import with_share
from .series import GROUPED

CELL = ["grouping", "scenario", "model"]
LEVEL_COLS = ["region_adj", "category_detail", "territory"]
METRICS = ["mape", "wape", "smape", "ape_max", "bias", "mae", "rmse", "rmse_consumption"]


def jn_grid(rows: DataFrame, models: Sequence[str], scenarios: Sequence[str]) -> DataFrame:
    """Series x month x model x scenario."""
    m = F.explode(F.array(*[F.lit(x) for x in models]))
    s = F.explode(F.array(*[F.lit(x) for x in scenarios]))
    return rows.select("*", m.alias("model")).select("*", s.alias("scenario"))


def jn_assemble(
    actual: DataFrame, forecasts: DataFrame, fallback: DataFrame, info: DataFrame, units: DataFrame | None,
    models: Sequence[str], scenarios: Sequence[str], use: str,
) -> DataFrame:
    """Forecast against actual for every cell of the grid.

    Series-level tables join before the grid is spread over models and
    scenarios, so the wide product meets only the forecasts.
    """
    kind = "adj" if use == "adjusted" else "raw"
    base = actual.select(
        *GROUPED, "period", F.col(f"units_{kind}").alias("units"), F.col(f"vol_{kind}").alias("vol_actual")
    )
    base = base.join(fallback.select(*GROUPED, "period", "consumption_fb"), [*GROUPED, "period"], "left")
    base = base.join(info.select(*GROUPED, "eligible"), GROUPED, "left")
    if units is not None:
        base = base.join(units.select(*GROUPED, "period", F.col("units").alias("units_fc")), [*GROUPED, "period"], "left")
    else:
        base = base.withColumn("units_fc", F.lit(None).cast("double"))
    cells = jn_grid(base, models, scenarios).join(forecasts, [*GROUPED, "period", "model", "scenario"], "left")
    return fc_volume_test(cells)


def fc_volume_test(cells: DataFrame) -> DataFrame:
    """Volume of each cell and where it comes from."""
    bad = F.col("forecast").isNull() | F.isnan("forecast") | (F.abs("forecast") == F.lit(float("inf")))
    kind = F.when(~F.coalesce("eligible", F.lit(False)), "nao_elegivel").when(bad, "falha_modelo").otherwise("modelo")
    units = F.coalesce("units_fc", "units")
    vol = (
        F.when(kind != "modelo", F.col("consumption_fb") * units)
        .when(F.col("model").isin(*VOLUME_MODELS), F.col("forecast"))
        .otherwise(F.col("forecast") * units)
    )
    return cells.select(*CELL, *[c for c in GROUPED if c != "grouping"], "period", "units", "vol_actual",
                        vol.alias("vol_fit"), kind.alias("fallback"))


def prj_month_merge(cells: DataFrame, groups: Sequence[Sequence[date]]) -> DataFrame:
    """Months judged together take the first month of their group."""
    period = F.col("period")
    for g in groups:
        period = F.when(F.col("period").isin(*g), F.lit(min(g))).otherwise(period)
    return cells.withColumn("period", period)


def metric_columns() -> list[Column]:
    """Error measures, snapped so that equal errors rank as equal."""
    real, fit = F.col("vol_actual"), F.col("vol_fit")
    e = fit - real
    values = {
        "mape": F.avg(F.abs(e) / real) * 100,
        "wape": ratio(F.sum(F.abs(e)), F.sum(real)) * 100,
        "smape": F.avg(F.try_divide(2 * F.abs(e), F.abs(real) + F.abs(fit))) * 100,
        "ape_max": F.max(F.abs(e) / real) * 100,
        "bias": ratio(F.sum(e), F.sum(real)) * 100,
        "mae": F.avg(F.abs(e)),
        "rmse": F.sqrt(F.avg(e * e)),
        "rmse_consumption": F.sqrt(F.avg(F.pow(F.try_divide(e, F.col("units")), F.lit(2.0)))),
    }
    return [*[snap_round(v, 8).alias(k) for k, v in values.items()], F.count("*").alias("n")]


def acc_metrics(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cells.where(F.col("vol_actual") > 0).groupBy(*keys).agg(*metric_columns())


def _sums() -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("units", "vol_actual", "vol_fit")]


def acc_at(cells: DataFrame, level: Sequence[str], by: Sequence[str] = (), detail: bool = False) -> DataFrame:
    """Metrics of one level: cells summed to level x month first."""
    dims = list(dict.fromkeys([*level, *by]))
    agg = cells.groupBy(*CELL, *dims, "period").agg(*_sums())
    keys = list(dict.fromkeys([*CELL, *(dims if detail else []), *by]))
    return acc_metrics(agg, keys)


def acc_levels(cells: DataFrame) -> DataFrame:
    """Every level in one pass: cells fold to the finest level, grouping sets
    give the coarser ones."""
    fine = cells.groupBy(*CELL, *LEVEL_COLS, "period").agg(*_sums())
    sets = [[F.col(c) for c in (*CELL, "period", *dims)] for dims in ACCURACY_LEVELS.values()]
    cols = [F.col(c) for c in (*CELL, "period", *LEVEL_COLS)]
    cube = fine.groupingSets(sets, *cols).agg(
        F.grouping("region_adj").alias("_r"),
        F.grouping("category_detail").alias("_c"), F.grouping("territory").alias("_t"), *_sums(),
    )
    name = F.lit(None).cast("string")
    for lv, dims in ACCURACY_LEVELS.items():
        hit = [F.col(f) == (0 if c in dims else 1) for c, f in zip(LEVEL_COLS, ("_r", "_c", "_t"))]
        name = F.when(reduce(lambda a, b: a & b, hit), lv).otherwise(name)
    return acc_metrics(cube.withColumn("level", name), ["level", *CELL])


# -- external forecast ------------------------------------------------------


def prj_ext_map(rows: DataFrame) -> DataFrame:
    """The consultant's coarser region and category."""
    region = F.when(F.col("region_adj").startswith("SP_"), EXTERNAL_CAPITAL)
    for k, v in EXTERNAL_REGIONS.items():
        region = region.when(F.col("region_adj") == k, v)
    cat = F.when(F.col("category_detail").startswith(SOCIAL_PREFIX), SOCIAL_PREFIX).otherwise(F.col("category_detail"))
    return rows.withColumns({"ext_region": region.otherwise(F.col("region_adj")), "ext_category": cat})


def acc_external(external: DataFrame, keys: DataFrame, first: date, last: date, scenarios: Sequence[str]) -> DataFrame:
    """External consumption x actual units, at its own granularity, in every
    scenario.  ``covered`` marks rows the external file reaches."""
    real = keys.where(F.col("period").between(F.lit(first), F.lit(last))).groupBy(*LEVEL_COLS, "period").agg(
        F.sum("vol").alias("vol_actual"), F.sum("units").alias("units")
    )
    names = {c: normalise_name(c) for c in ("ext_region", "ext_category")}
    ext = external.withColumns(names).groupBy("ext_region", "ext_category", "period").agg(
        ratio(F.sum("vol"), F.sum("units")).alias("consumption_ext")
    )
    rows = prj_ext_map(real).withColumns(names).join(ext, ["ext_region", "ext_category", "period"], "left")
    rows = rows.withColumn("covered", F.col("consumption_ext").isNotNull())
    s = F.explode(F.array(*[F.lit(x) for x in scenarios]))
    return rows.select("*", s.alias("scenario")).select(
        F.lit(EXTERNAL).alias("grouping"), "scenario", F.lit(EXTERNAL).alias("model"), *LEVEL_COLS, "period", "units",
        "vol_actual", (F.col("consumption_ext") * F.col("units")).alias("vol_fit"), "covered",
    )


def ext_coverage(ext_cells: DataFrame) -> DataFrame:
    return ext_cells.groupBy("scenario").agg(
        ratio(F.sum(F.when(F.col("covered"), F.col("vol_actual")).otherwise(0.0)), F.sum("vol_actual")).alias("share_covered")
    )


# -- selection --------------------------------------------------------------


def win_rank(acc: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(metric, "grouping", "model")
    return acc.withColumn("rank", F.row_number().over(w))


def top_rank3(ranked: DataFrame) -> DataFrame:
    return ranked.where(F.col("rank") <= 3)


def top_argmin(acc: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """Grouping and model at the smallest metric."""
    at = F.struct(metric, "grouping", "model")
    return acc.groupBy(*by).agg(
        F.min_by("grouping", at).alias("grouping"), F.min_by("model", at).alias("model"), F.min(metric).alias(metric)
    )


def _rank_within(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("metric_best", label)
    return df.withColumn("rank", F.row_number().over(w))


def sel_models(acc: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """Best grouping of each model."""
    rows = acc.where(~F.col("grouping").isin(EXTERNAL, COMBINED))
    g = rows.groupBy(*by, "model").agg(
        F.min_by("grouping", F.struct(metric, "grouping")).alias("best_grouping"),
        F.min(metric).alias("metric_best"),
        F.avg(metric).alias("metric_mean"),
    ).withColumn("benchmark", F.col("model").isin(*BENCHMARKS))
    return _rank_within(g, by, "model")


def sel_group(acc: DataFrame, n_series: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """Best model of each grouping, benchmarks aside."""
    rows = acc.where(~F.col("grouping").isin(EXTERNAL, COMBINED) & ~F.col("model").isin(*BENCHMARKS))
    g = rows.groupBy(*by, "grouping").agg(
        F.min_by("model", F.struct(metric, "model")).alias("best_model"),
        F.min(metric).alias("metric_best"),
        median(metric).alias("metric_median"),  # one value per model
    ).join(n_series, "grouping", "left")
    return _rank_within(g, by, "grouping")


def win_tol_pick(ranked: DataFrame, n_series: DataFrame, by: Sequence[str], metric: str, tol: float) -> DataFrame:
    """Among those within the tolerance of the best: no drift first, then fewer
    series, then the smaller error."""
    rows = ranked.where((F.col("grouping") != EXTERNAL) & ~F.col("model").isin(*BENCHMARKS)).join(
        n_series, "grouping", "left"
    )
    best = F.min(metric).over(Window.partitionBy(*by))
    close = rows.withColumn("_best", best).where(F.col(metric) <= F.col("_best") + tol).drop("_best")
    drift = F.when(F.col("model").isin(*DRIFTLESS), 0).otherwise(1)
    w = Window.partitionBy(*by).orderBy(drift, "n_series", metric, "grouping", "model")
    return close.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def sel_choice(ranked: DataFrame, n_series: DataFrame, by: Sequence[str], metric: str, tol: float) -> DataFrame:
    pick = win_tol_pick(ranked, n_series, by, metric, tol)
    chosen = pick.select(*by, "grouping", "model", F.lit(True).alias("chosen"))
    return ranked.join(chosen, [*by, "grouping", "model"], "left").withColumn(
        "chosen", F.coalesce("chosen", F.lit(False))
    )


def sel_combined(cells: DataFrame, choice: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cells of each category's own choice, under one label."""
    rows = cells.join(choice.where("chosen").select(*by, "grouping", "model"), [*by, "grouping", "model"])
    return rows.withColumns({"grouping": F.lit(COMBINED), "model": F.lit(CHOSEN)}).select(*cells.columns)


def sel_decision(
    choice: DataFrame, combined_total: DataFrame, b: BacktestParams, target: str
) -> DataFrame:
    """Decision record per category: the choice and what it is judged against."""
    by, m = list(b.select_by), b.metric
    ranked = choice.where(F.col("grouping") != EXTERNAL)
    bench = F.col("model").isin(*BENCHMARKS)
    ref = ranked.groupBy(*by).agg(
        F.min(F.when(~bench, F.col(m))).alias("best_value"), F.min(F.when(bench, F.col(m))).alias("benchmark_value")
    )
    rows = choice.where("chosen").join(ref, by).crossJoin(
        F.broadcast(combined_total.select(
            F.col("mape").alias("mape_combined"), F.col("wape").alias("wape_combined"), F.col("bias").alias("bias_combined")
        ))
    )
    kind = F.when(F.col("model").isin(*VOLUME_MODELS), "volume").otherwise("consumo/economia")
    return rows.select(
        F.lit(b.segment).alias("segment"), F.lit(target).alias("target"), *by, "grouping", "model", kind.alias("model_kind"),
        F.lit(b.select_level).alias("level"), F.lit(b.select_scenario).alias("scenario"), F.lit(m).alias("metric"),
        F.col(m).alias("value"), "best_value", "benchmark_value", F.lit(b.tolerance).alias("tolerance"),
        "mape_combined", "wape_combined", "bias_combined",
    )


# -- summaries of cells -----------------------------------------------------


def agg_fallback_share(cells: DataFrame) -> DataFrame:
    g = cells.where(F.col("scenario") == "realizado").groupBy("grouping", "model", "fallback").agg(
        F.sum("vol_actual").alias("vol"), F.count("*").alias("n")
    )
    return with_share(g, "vol", ["grouping", "model"], "share")


def agg_real_x_forecast(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*CELL, *LEVEL_COLS, "period").agg(*_sums())


def agg_total_series(ts: DataFrame, cells: DataFrame, first: date) -> DataFrame:
    """Actual and forecast totals in millions per month."""
    actual = ts.where((F.col("period") >= F.lit(first)) & ~F.col("filled")).groupBy("grouping", "period").agg(
        (F.sum("vol_raw") / 1e6).alias("vol")
    )
    fc = cells.groupBy(*CELL, "period").agg((F.sum("vol_fit") / 1e6).alias("vol"))
    return actual.withColumn("kind", F.lit("real")).unionByName(
        fc.withColumn("kind", F.lit("forecast")), allowMissingColumns=True
    )


# -- elasticities -----------------------------------------------------------


def win_iqr(coefs: DataFrame) -> DataFrame:
    """Flag coefficients outside Q1 - 2 IQR .. Q3 + 2 IQR of their model term."""
    keys = ["grouping", "model", "term"]
    q = exact_quantiles(coefs, keys, "estimate", {"q1": 0.25, "q3": 0.75})
    span = 2 * (F.col("q3") - F.col("q1"))
    out = (F.col("estimate") < F.col("q1") - span) | (F.col("estimate") > F.col("q3") + span)
    return coefs.join(q, keys).withColumn("outlier", out).drop("q1", "q3")


def el_coef(raw: DataFrame, train: DataFrame, terms: DataFrame) -> DataFrame:
    """Coefficients in logs are elasticities.  A missing p-value is not
    significant; the weight is the last year's volume."""
    w = Window.partitionBy(*GROUPED).orderBy(F.desc("period"))
    weight = train.withColumn("_rn", F.row_number().over(w)).where("_rn <= 12").groupBy(*GROUPED).agg(
        F.coalesce(F.sum("vol_adj"), F.lit(0.0)).alias("weight")
    )
    rows = raw.join(F.broadcast(terms), "term").join(weight, GROUPED, "left")
    rows = rows.withColumns(
        {
            "significant": F.coalesce(F.col("p_value") <= 0.05, F.lit(False)),
            "sign_ok": F.signum("estimate") == F.col("expected_sign"),
        }
    )
    return win_iqr(rows)


def el_summary(coefs: DataFrame, level: Sequence[str]) -> DataFrame:
    """Distribution of the elasticities, outliers aside."""
    keys = ["grouping", "model", "variable", "term", *level]
    keep = ~F.col("outlier")
    share = lambda c: F.avg(F.when(keep, F.col(c).cast("double")))
    g = coefs.groupBy(*keys).agg(
        F.count("*").alias("n_series"),
        F.count_if("outlier").alias("n_outliers"),
        ratio(F.sum(F.when(keep, F.col("estimate") * F.col("weight"))), F.sum(F.when(keep, F.col("weight")))).alias("weighted_mean"),
        share("significant").alias("share_significant"),
        share("sign_ok").alias("share_expected_sign"),
    )
    q = exact_quantiles(coefs.where(keep), keys, "estimate", {"median": 0.5, "p25": 0.25, "p75": 0.75})
    return g.join(q, keys, "left")


# -- diagnostics ------------------------------------------------------------


def series_accuracy(cells: DataFrame, scenario: str) -> DataFrame:
    rows = cells.where(F.col("scenario") == scenario)
    e = F.col("vol_fit") - F.col("vol_actual")
    return rows.groupBy("model", *GROUPED).agg(
        (ratio(F.sum(F.abs(e)), F.sum("vol_actual")) * 100).alias("wape"),
        (ratio(F.sum(e), F.sum("vol_actual")) * 100).alias("bias"),
        F.sum("vol_actual").alias("vol_test"),
    )


def top_modes(specs: DataFrame, keys: Sequence[str], n: int = 3) -> DataFrame:
    """The most frequent specifications of each group, as one text."""
    g = specs.groupBy(*keys, "spec").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys).orderBy(F.desc("c"), "spec")
    top = g.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    parts = F.array_sort(F.collect_list(F.struct("rn", "spec")))  # at most n entries
    return top.groupBy(*keys).agg(F.concat_ws(" | ", F.transform(parts, lambda s: s["spec"])).alias("common_specs"))


def dg_summary(diag: DataFrame, fallback_share: DataFrame, best: DataFrame) -> DataFrame:
    """One row per chosen grouping x model."""
    keys = ["grouping", "model"]
    frac = lambda c: F.avg(c.cast("double"))
    g = diag.groupBy(*keys).agg(
        F.count("*").alias("n_series"),
        frac(F.col("spec") == "NULL model").alias("share_null"),
        frac(F.col("spec").rlike(r"ARIMA\(\d,[1-9]")).alias("share_differenced"),
        frac(F.col("spec").rlike(r"\)\(")).alias("share_seasonal"),
        frac(F.col("lb_p_value") > 0.05).alias("share_lb_ok"),
        F.count("lb_p_value").alias("n_lb"),  # the series that share is over
    )
    fb = fallback_share.where(F.col("fallback") != "modelo").groupBy(*keys).agg(F.sum("share").alias("share_fallback"))
    for column, wanted in (
        ("aicc", {"aicc_median": 0.5}), ("sd", {"sd_median": 0.5}), ("wape", {"wape_median": 0.5, "wape_p90": 0.9}),
    ):
        g = g.join(exact_quantiles(diag.withColumn("sd", F.sqrt("sigma2")), keys, column, wanted), keys, "left")
    rows = g.join(top_modes(diag, keys), keys, "left").join(fb, keys, "left")
    rows = rows.withColumn("share_fallback", F.coalesce("share_fallback", F.lit(0.0)))
    return jn_right(rows, best)


def jn_right(stats: DataFrame, chosen: DataFrame) -> DataFrame:
    """Statistics of the chosen ones; a chosen one without any stays."""
    return stats.join(chosen, ["grouping", "model"], "right")

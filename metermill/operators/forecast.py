"""Scenarios, forecasts without a fitted model, and units."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions.dates import month_index, shift
from ..functions.numeric import ratio, weighted_mean
from ..functions.windows import complete_months, interpolate_months, over_time
from ..params import ProjectionParams
from ..sources.values import relation
from .series import EXOG, GROUPED

SEGMENT = ["grouping", "region_adj", "category_detail", "territory"]
CAT_TERR = ["grouping", "category_detail", "territory"]


def month_number(d: date) -> int:
    return d.year * 12 + d.month - 1


def future_grid(keys: DataFrame, cols: Sequence[str], first: date, last: date) -> DataFrame:
    months = F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 month")))
    return keys.select(*cols, months.alias("period"))


# -- scenarios --------------------------------------------------------------


def agg_climatology(ts: DataFrame, hist_end: date) -> DataFrame:
    """Mean, spread and minimum of the climate per series x calendar month."""
    past = ts.where(F.col("period") <= F.lit(hist_end))
    return past.groupBy(*GROUPED, F.month("period").alias("mon")).agg(
        F.avg("temp_med").alias("temp_mu"),
        F.coalesce(F.stddev_samp("temp_med"), F.lit(0.0)).alias("temp_sd"),
        F.avg("prec_tot").alias("prec_mu"),
        F.coalesce(F.stddev_samp("prec_tot"), F.lit(0.0)).alias("prec_sd"),
        F.min("prec_tot").alias("prec_min"),
    )


def agg_jobs_trend(ts: DataFrame, hist_end: date) -> DataFrame:
    """Last jobs value and monthly growth over the last twelve months."""
    past = ts.where(F.col("period") <= F.lit(hist_end))
    w = Window.partitionBy(*GROUPED).orderBy(F.desc("period"))
    ranked = past.withColumn("_rn", F.row_number().over(w)).where("_rn in (1, 13)")
    g = ranked.groupBy(*GROUPED).agg(
        F.max(F.when(F.col("_rn") == 1, F.col("jobs"))).alias("jobs_last"),
        F.max(F.when(F.col("_rn") == 13, F.col("jobs"))).alias("_j13"),
    )
    step = ratio("jobs_last", "_j13")
    growth = F.when(step >= 0, F.pow(step, F.lit(1 / 12)) - 1)
    return g.select(*GROUPED, "jobs_last", F.coalesce(growth, F.lit(0.0)).alias("g"))


def sc_exante(ts: DataFrame, grid: DataFrame, hist_end: date) -> DataFrame:
    """Three ex-ante scenarios on the future months of each series."""
    rows = (
        grid.withColumn("mon", F.month("period"))
        .join(agg_climatology(ts, hist_end), [*GROUPED, "mon"], "left")
        .join(agg_jobs_trend(ts, hist_end), GROUPED, "left")
    )
    k = (month_index("period") - month_number(hist_end)).cast("double")
    jobs = F.col("jobs_last") * F.pow(1 + F.col("g"), k)
    tm, ts_, pm, ps, pmin = (F.col(c) for c in ("temp_mu", "temp_sd", "prec_mu", "prec_sd", "prec_min"))
    cases = F.array(
        _scenario("base", tm, pm),
        _scenario("quente_seco", tm + ts_, F.greatest(pm - ps, pmin)),
        _scenario("frio_umido", F.greatest(tm - ts_, F.lit(1.0)), pm + ps),
    )
    return rows.select(*GROUPED, "period", jobs.alias("jobs"), F.explode(cases).alias("s")).select(
        *GROUPED, "period", "s.scenario", "s.temp_med", "s.prec_tot", "jobs"
    )


def _scenario(name: str, temp: Column, prec: Column) -> Column:
    return F.struct(F.lit(name).alias("scenario"), temp.alias("temp_med"), prec.alias("prec_tot"))


def sc_realized(ts: DataFrame, first: date, last: date) -> DataFrame:
    rows = ts.where(F.col("period").between(F.lit(first), F.lit(last)))
    return rows.select(*GROUPED, "period", F.lit("realizado").alias("scenario"), "temp_med", "prec_tot", "jobs")


def win_circular(monthly: DataFrame, keys: Sequence[str], cols: Sequence[str], width: int) -> DataFrame:
    """Centred mean over the twelve calendar months, December next to January."""
    if width <= 1:
        return monthly
    h = (width - 1) // 2
    offsets = F.explode(F.sequence(F.lit(-h), F.lit(h)))
    spread = monthly.select(*keys, "mon", *cols, offsets.alias("_o")).withColumn(
        "mon", F.pmod(F.col("mon") + F.col("_o") - 1, F.lit(12)) + 1
    )
    return spread.groupBy(*keys, "mon").agg(*[F.avg(c).alias(c) for c in cols])


def sc_anomaly(ts: DataFrame, p: ProjectionParams) -> DataFrame:
    """Anomalies of an analogue event per region x calendar month: degrees for
    temperature, a clipped ratio for rain, both smoothed; none where unknown."""
    keys = ["grouping", "region_adj"]
    reg = ts.groupBy(*keys, "period").agg(
        weighted_mean("temp_med", "units_adj").alias("temp"), weighted_mean("prec_tot", "units_adj").alias("prec")
    ).withColumn("mon", F.month("period"))
    event = F.col("period").between(F.lit(p.analogue_from), F.lit(p.analogue_to))
    monthly = reg.groupBy(*keys, "mon").agg(
        F.avg("temp").alias("tc"), F.avg("prec").alias("pc"),
        F.avg(F.when(event, F.col("temp"))).alias("te"), F.avg(F.when(event, F.col("prec"))).alias("pe"),
    )
    regions = reg.where(event).select(*keys).distinct()
    grid = regions.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(12))).alias("mon"))
    rows = grid.join(monthly, [*keys, "mon"], "left").select(
        *keys, "mon",
        F.coalesce(F.col("te") - F.col("tc"), F.lit(0.0)).alias("temp_anom"),
        F.coalesce(F.ln(ratio("pe", "pc")), F.lit(0.0)).alias("prec_log"),
    )
    rows = win_circular(rows, keys, ["temp_anom", "prec_log"], p.smoothing)
    clipped = F.greatest(F.least(F.exp("prec_log"), F.lit(2.0)), F.lit(0.5))
    return rows.select(*keys, "mon", "temp_anom", clipped.alias("prec_ratio"))


def sc_apply(scenario: DataFrame, anomalies: DataFrame, p: ProjectionParams, name: str) -> DataFrame:
    """A scenario with the anomalies in the chosen months."""
    rows = scenario.withColumn("mon", F.month("period")).join(anomalies, ["grouping", "region_adj", "mon"], "left")
    on = F.col("period").between(F.lit(p.apply_from), F.lit(p.apply_to))
    i = F.lit(p.intensity)
    temp = F.when(on, F.col("temp_med") + i * F.coalesce("temp_anom", F.lit(0.0))).otherwise(F.col("temp_med"))
    prec = F.when(on, F.col("prec_tot") * F.pow(F.coalesce("prec_ratio", F.lit(1.0)), i)).otherwise(F.col("prec_tot"))
    return rows.select(
        *GROUPED, "period", F.lit(name).alias("scenario"), temp.alias("temp_med"), prec.alias("prec_tot"), "jobs"
    )


def sc_summary(scenarios: DataFrame, info: DataFrame) -> DataFrame:
    """Volume-weighted climate and summed jobs per scenario x month."""
    rows = scenarios.join(info.select(*GROUPED, "vol_12m"), GROUPED, "left")
    return rows.groupBy("grouping", "scenario", "period").agg(
        weighted_mean("temp_med", "vol_12m").alias("temp_med"),
        weighted_mean("prec_tot", "vol_12m").alias("prec_tot"),
        F.sum("jobs").alias("jobs"),
    )


# -- fallback ---------------------------------------------------------------


def _observed(ts: DataFrame, hist_end: date) -> DataFrame:
    return ts.where((F.col("period") <= F.lit(hist_end)) & ~F.col("filled") & F.col("consumption").isNotNull())


def jn_lagmonth(grid: DataFrame, history: DataFrame, hist_end: date, value: str, out: str) -> DataFrame:
    """Same calendar month of the last observed year, any number of years ahead."""
    k = month_index("period") - month_number(hist_end)
    rows = grid.withColumn("_src", shift("period", (-12 * F.ceil(k / 12)).cast("int")))
    past = history.select(*GROUPED, F.col("period").alias("_src"), F.col(value).alias(out))
    return rows.join(past, [*GROUPED, "_src"], "left").drop("_src")


def fc_snaive(ts: DataFrame, grid: DataFrame, hist_end: date) -> DataFrame:
    return jn_lagmonth(grid, _observed(ts, hist_end), hist_end, "consumption", "consumption_snaive")


def win_last12(ts: DataFrame, hist_end: date) -> DataFrame:
    """Last twelve observed months of each series."""
    w = Window.partitionBy(*GROUPED).orderBy(F.desc("period"))
    return _observed(ts, hist_end).withColumn("rn", F.row_number().over(w)).where("rn <= 12")


def agg_fallback(ts: DataFrame, hist_end: date) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mean of the last year, segment ratio, category ratio."""
    recent = _observed(ts, hist_end).where(F.col("period") > shift(F.lit(hist_end), -12))
    last = win_last12(ts, hist_end).groupBy(*GROUPED).agg(F.avg("consumption").alias("consumption_mean12"))
    seg = recent.groupBy(*SEGMENT).agg(ratio(F.sum("vol_adj"), F.sum("units_adj")).alias("consumption_seg"))
    cat = recent.groupBy(*CAT_TERR).agg(ratio(F.sum("vol_adj"), F.sum("units_adj")).alias("consumption_cat"))
    return last, seg, cat


def fc_fallback(ts: DataFrame, grid: DataFrame, hist_end: date) -> DataFrame:
    """Seasonal naive, else last-year mean, else segment, else category."""
    last, seg, cat = agg_fallback(ts, hist_end)
    rows = fc_snaive(ts, grid, hist_end).join(last, GROUPED, "left").join(seg, SEGMENT, "left").join(cat, CAT_TERR, "left")
    parts = ["consumption_snaive", "consumption_mean12", "consumption_seg", "consumption_cat"]
    return rows.select(*GROUPED, "period", *parts, F.coalesce(*parts).alias("consumption_fb"))


# -- units ------------------------------------------------------------------

# Start of the damped trend's search: smoothing of level and slope, damping.
ALPHAS, BETAS, PHIS = (0.1, 0.3, 0.5, 0.7, 0.9), (0.02, 0.05, 0.1), (0.8, 0.9, 0.98)
# The search moves on whole multiples of 1 / UNIT: bounds of each parameter, and the steps (level; slope and damping) it goes through.
UNIT = 2000
BOUNDS = {"a": (100, 1900), "b": (20, 1000), "f": (1600, 1960)}
STEPS = ((200, 80), (100, 40), (50, 20), (25, 10), (12, 5), (6, 2), (3, 1), (1, 1))
MOVES = 64
# Along the axes, and along the diagonals: level and slope trade off against each other, so the valley is slanted.
DIRECTIONS = tuple(d for d in product((-1, 0, 1), repeat=3) if sum(map(abs, d)) in (1, 3))


def damped_grid() -> list[tuple[int, float, float, float]]:
    grid = [(a, b, f) for a in ALPHAS for b in BETAS for f in PHIS]
    return [(i, *g) for i, g in enumerate(grid)]


def _damped_run(y: Column, c: Column) -> Column:
    """Level, slope and squared error after the array ``y`` with parameters ``c`` (whole multiples); first the error, rounded."""
    a, b, f = (c[k] / F.lit(float(UNIT)) for k in "abf")
    start = F.struct(y[0].alias("l"), ((y[11] - y[0]) / F.lit(11.0)).alias("s"), F.lit(0.0).alias("sse"))

    def step(acc: Column, x: Column) -> Column:
        base = acc["l"] + f * acc["s"]
        e = x - base
        return F.struct((base + a * e).alias("l"), (f * acc["s"] + b * e).alias("s"), (acc["sse"] + e * e).alias("sse"))

    end = F.aggregate(F.slice(y, F.lit(2), F.size(y) - 1), start, step)
    return F.struct(F.round(end["sse"], 9).alias("sse"), c["i"].alias("i"), *[c[k].alias(k) for k in "abf"], end["l"].alias("l"), end["s"].alias("s"))


def _candidates(rows: Sequence[tuple[int, int, int, int]]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("iabf", row)]) for row in rows])


def damped_fit(y: Column) -> Column:
    """The damped trend of an array of logs: sse, a, b, f (multiples of 1 / UNIT), l, s.

    The best point of a grid, then a compass search: of the points one step away the best replaces the centre, and where none is
    better the step shrinks.  It never ends above the grid.  Ties go to the first candidate, and errors count to nine digits, so that
    the search does not hang on the last bits.
    """
    grid = _candidates([(i, round(a * UNIT), round(b * UNIT), round(f * UNIT)) for i, a, b, f in damped_grid()])
    start = F.array_min(F.transform(grid, lambda c: _damped_run(y, c)))
    ways = _candidates([(i, *d) for i, d in enumerate(DIRECTIONS)])
    wide, fine = (F.array(*[F.lit(s[k]) for s in STEPS]) for k in (0, 1))

    def move(acc: Column, _: Column) -> Column:
        at, k = acc["m"], acc["k"]
        far = {"a": F.get(wide, k), "b": F.get(fine, k), "f": F.get(fine, k)}

        def near(d: Column) -> Column:
            bound = [F.least(F.greatest(at[n] + d[n] * far[n], F.lit(BOUNDS[n][0])), F.lit(BOUNDS[n][1])).alias(n) for n in "abf"]
            return _damped_run(y, F.struct(d["i"].alias("i"), *bound))

        def chosen(best: Column) -> Column:
            better = best["sse"] < at["sse"]
            return F.struct(F.when(better, best).otherwise(at).alias("m"), F.when(better, k).otherwise(k + 1).alias("k"))

        # the list of one lets the best point be named once and used twice
        moved = F.transform(F.array(F.array_min(F.transform(ways, near))), chosen)[0]
        return F.when(k < len(STEPS), moved).otherwise(acc)

    first = F.struct(start.alias("m"), F.lit(0).alias("k"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(MOVES)), first, move)["m"]


def fc_damped(levels: DataFrame, keys: Sequence[str], value: str, first: date, last: date, min_obs: int) -> DataFrame:
    """Damped additive trend on the log of a monthly total, per key.

    The months of a key travel as one short array and its parameters are searched inside the row (``damped_fit``), so nothing is
    shuffled per candidate.  The mean forecast adds half the variance of the log.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("period", F.ln(value).alias("y")))), lambda s: s["y"])
    rows = levels.groupBy(*keys).agg(ordered.alias("y"), F.max("period").alias("end"))
    rows = rows.where(F.size("y") >= min_obs)
    best = rows.select(*keys, "end", F.size("y").alias("n"), damped_fit(F.col("y")).alias("m"))
    fut = future_grid(best, [*keys, "end", "n", "m"], first, last)
    h = (month_index("period") - month_index("end")).cast("double")
    a, b, f = (F.col(f"m.{k}") / F.lit(float(UNIT)) for k in "abf")
    damp = f * (1 - F.pow(f, h)) / (1 - f)
    mu = F.col("m.l") + F.col("m.s") * damp
    # variance of the h-step error: 1 + sum of (a + b (f + .. + f^j))^2, j < h
    psi = F.aggregate(
        F.sequence(F.lit(1), F.greatest(h.cast("int") - 1, F.lit(1))), F.lit(0.0),
        lambda acc, j: acc + F.when(j < h, F.pow(a + b * f * (1 - F.pow(f, j)) / (1 - f), F.lit(2.0))).otherwise(0.0),
    )
    sigma2 = F.col("m.sse") / (F.col("n") - 1)
    return fut.select(
        *keys, "period", a.alias("alpha"), b.alias("beta"), f.alias("phi"), (F.exp(mu) * (1 + sigma2 * (1 + psi) / 2)).alias("forecast")
    )


def level_totals(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    total = rows.groupBy(*keys, "period").agg(F.sum(value).alias("total"))
    return interpolate_months(complete_months(total, keys), keys, ["total"])


def agg_units_part(last_rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Share of each row in its level at the last month."""
    total = last_rows.groupBy(*keys).agg(F.sum(value).alias("_t"))
    return last_rows.join(total, list(keys)).withColumn("part", ratio(value, "_t")).drop("_t")


def fc_units_key(keys: DataFrame, hist_end: date, last: date, p: ProjectionParams) -> DataFrame:
    """Units per series: the level's total by damped trend, split by the last
    month's shares; short levels repeat the last value."""
    level = list(p.units_level)
    now = keys.where(F.col("period") == F.lit(hist_end)).select("series_key", *level, F.col("units_adj").alias("units_last"))
    now = agg_units_part(now, level, "units_last")
    past = keys.where(F.col("period") <= F.lit(hist_end)).join(now.select(*level).distinct(), level, "left_semi")
    first = shift_date(hist_end, 1)
    fc = fc_damped(level_totals(past, level, "units_adj"), level, "total", first, last, p.min_obs_units)
    grid = future_grid(now, ["series_key", *level, "units_last", "part"], first, last)
    rows = grid.join(fc, [*level, "period"], "left")
    ok = F.col("forecast").isNotNull()
    units = F.when(ok, F.col("forecast") * F.col("part")).otherwise(F.col("units_last"))
    return rows.select(
        "series_key", "period", units.alias("units"), units.alias("units_trend"),
        F.when(ok, "ets_amortecido").otherwise("ultimo_valor").alias("method"),
    )


def shift_date(d: date, k: int) -> date:
    i = month_number(d) + k
    return date(i // 12, i % 12 + 1, 1)


def fc_units_series(ts: DataFrame, info: DataFrame, hist_end: date, first: date, last: date, over_categories: bool,
                    min_obs: int) -> DataFrame:
    """Units per model series in the test months, by level total and share."""
    keys = [c for c in GROUPED if c != "category_detail"] if over_categories else list(GROUPED)
    active = info.where("active").select(*GROUPED)
    hist = ts.where(F.col("period") <= F.lit(hist_end)).join(active, GROUPED, "left_semi")
    now = agg_units_part(hist.where(F.col("period") == F.lit(hist_end)).select(*GROUPED, "units_adj"), keys, "units_adj")
    fc = fc_damped(level_totals(hist, keys, "units_adj"), keys, "total", first, last, min_obs)
    grid = future_grid(now, [*GROUPED, F.col("units_adj").alias("units_last"), "part"], first, last)
    rows = grid.join(fc, [*keys, "period"], "left")
    value = F.coalesce(F.col("forecast") * F.col("part"), F.col("units_last"))
    method = F.when(F.col("forecast").isNotNull(), "ets_amortecido").otherwise("ultimo_valor")
    return rows.select(*GROUPED, "period", value.alias("units"), method.alias("method"))


# -- tariff -----------------------------------------------------------------


def win_horizon(keys: DataFrame, first: date, last: date) -> DataFrame:
    grid = future_grid(keys, keys.columns, first, last)
    return grid.withColumn("k", (month_index("period") - month_number(first) + 1).cast("int"))


def fc_tariff_path(tariff: DataFrame, hist_end: date, p: ProjectionParams) -> DataFrame:
    """Real tariff ahead: eroded by inflation, raised from the adjustment month;
    the reference is the mean of the last twelve months."""
    w = Window.partitionBy("category_detail").orderBy(F.desc("period"))
    ranked = tariff.where(F.col("period") <= F.lit(hist_end)).withColumn("_rn", F.row_number().over(w))
    ref = ranked.where("_rn <= 12").groupBy("category_detail").agg(
        F.max(F.when(F.col("_rn") == 1, F.col("tariff"))).alias("tariff_last"), F.avg("tariff").alias("tariff_ref")
    )
    rows = win_horizon(ref, shift_date(hist_end, 1), p.last_period)
    monthly = (1 + p.inflation) ** (1 / 12)
    raised = F.when(F.col("period") >= F.lit(p.adjustment_month), 1 + p.adjustment).otherwise(1.0)
    path = F.col("tariff_last") / F.pow(F.lit(monthly), F.col("k")) * raised
    return rows.select("category_detail", "period", path.alias("tariff"), "tariff_ref")


def fc_tariff_factor(path: DataFrame, spark: SparkSession, p: ProjectionParams) -> DataFrame:
    """(tariff / reference) ^ elasticity, and its low and high sensitivity."""
    el = relation(spark, [("category_detail", "string"), ("eps", "double")], p.elasticity)
    rows = path.join(F.broadcast(el), "category_detail", "left")
    eps = F.coalesce("eps", F.lit(p.default_elasticity))
    rel = ratio("tariff", "tariff_ref")
    return rows.select(
        "category_detail", "period",
        F.pow(rel, eps).alias("factor"),
        F.pow(rel, eps * p.sensitivity_low).alias("factor_low"),
        F.pow(rel, eps * p.sensitivity_high).alias("factor_high"),
    )

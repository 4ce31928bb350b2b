"""Projection: new connections, units, volumes, monthly and annual results."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions.numeric import ratio
from ..functions.text import normalise_name
from ..functions.windows import UP_TO_NOW, over_time
from ..params import ProjectionParams
from ..rules import BOTH_SERVICES, USAGE_MAP, VOLUME_MODELS
from ..sources.values import relation
from .forecast import shift_date
from .series import GROUPED, prj_grouping

PAIR = ["municipality_norm", "usage_norm"]


def prj_usage_map(spark: SparkSession) -> DataFrame:
    """Usage of new connections -> category detail x territory (1 : n)."""
    ddl = [("usage", "string"), ("category_detail", "string"), ("territory", "string")]
    return relation(spark, ddl, USAGE_MAP).withColumn("usage_norm", normalise_name("usage")).drop("usage")


def service_of(target: str) -> str:
    return "AGUA" if target.endswith("agua") else "ESGOTO"


def premise_scope(premise: DataFrame, target: str) -> DataFrame:
    return premise.where((F.col("type_norm") == service_of(target)) | F.col("type_norm").isin(*BOTH_SERVICES))


def premise_increments(premise: DataFrame, target: str) -> DataFrame:
    return premise_scope(premise, target).groupBy(*PAIR, "period").agg(F.sum("increment").alias("increment"))


def jn_anti_pairs(pairs: DataFrame, matched: DataFrame) -> DataFrame:
    return pairs.join(matched.select(*PAIR).distinct(), PAIR, "left_anti")


def premise_targets(increments: DataFrame, keys: DataFrame, usage_map: DataFrame, hist_end: date) -> DataFrame:
    """Series that receive each municipality x usage, weighted by their units;
    without a matching series, every series of the municipality."""
    stock = keys.where(F.col("period") == F.lit(hist_end)).select(
        "series_key", normalise_name("municipality").alias("municipality_norm"), "category_detail", "territory", "units"
    )
    pairs = increments.select(*PAIR).distinct()
    own = pairs.join(F.broadcast(usage_map), "usage_norm").join(
        stock, ["municipality_norm", "category_detail", "territory"]
    ).select(*PAIR, "series_key", "units", F.lit("de_para").alias("rule"))
    rest = jn_anti_pairs(pairs, own).join(stock, "municipality_norm").select(
        *PAIR, "series_key", "units", F.lit("municipio").alias("rule")
    )
    rows = own.unionByName(rest)
    total = rows.groupBy(*PAIR).agg(F.sum("units").alias("_t"))
    return rows.join(total, PAIR).withColumn("weight", ratio("units", "_t")).drop("_t")


def agg_alloc(increments: DataFrame, targets: DataFrame) -> DataFrame:
    """Increments spread over the series; totals are kept where a target exists."""
    rows = increments.join(targets, PAIR)
    return rows.groupBy("series_key", "period", "rule").agg(F.sum(F.col("increment") * F.col("weight")).alias("increment"))


def alloc_report(increments: DataFrame, alloc: DataFrame) -> DataFrame:
    """Planned, allocated by rule, and left over."""
    total = increments.agg(F.sum("increment").alias("planned"))
    by = alloc.groupBy("rule").agg(F.sum("increment").alias("increment"))
    placed = alloc.agg(F.coalesce(F.sum("increment"), F.lit(0.0)).alias("_p"))
    rest = total.crossJoin(placed).select(F.lit("nao_alocado").alias("rule"), (F.col("planned") - F.col("_p")).alias("increment"))
    return by.unionByName(rest)


def covered_cities(premise: DataFrame, target: str, coverage: str) -> DataFrame:
    rows = premise if coverage == "municipality" else premise_scope(premise, target)
    return rows.select("municipality_norm").distinct()


def win_cum_inc(units: DataFrame, alloc: DataFrame) -> DataFrame:
    """Cumulative deliveries per series from the first premise month."""
    inc = alloc.groupBy("series_key", "period").agg(F.sum("increment").alias("inc"))
    rows = units.join(inc, ["series_key", "period"], "left").withColumn("inc", F.coalesce("inc", F.lit(0.0)))
    return rows.withColumn("inc_cum", F.sum("inc").over(over_time(["series_key"]).rowsBetween(*UP_TO_NOW)))


def fc_premise(
    units: DataFrame, alloc: DataFrame, keys: DataFrame, cities: DataFrame, hist_end: date, outside: str
) -> DataFrame:
    """Units with the engineering premise from its first month on.

    Covered series: stock of the month before plus cumulative deliveries.
    Others follow the trend, or stay constant.
    """
    start = alloc.agg(F.min("period").alias("p0"))  # one row
    covered = keys.select("series_key", normalise_name("municipality").alias("municipality_norm")).distinct().join(
        cities.withColumn("covered", F.lit(True)), "municipality_norm", "left"
    ).select("series_key", F.coalesce("covered", F.lit(False)).alias("covered"))
    rows = win_cum_inc(units, alloc).crossJoin(F.broadcast(start)).join(covered, "series_key", "left")
    before = F.col("period") == F.add_months("p0", -1)
    w = Window.partitionBy("series_key")
    now = keys.where(F.col("period") == F.lit(hist_end)).select("series_key", F.col("units_adj").alias("_now"))
    rows = rows.join(now, "series_key", "left").withColumn(
        "units_ref", F.coalesce(F.max(F.when(before, F.col("units"))).over(w), F.col("_now"))
    )
    cov = F.coalesce("covered", F.lit(False))
    use = (F.col("period") >= F.col("p0")) & (cov | F.lit(outside == "constant"))
    new = F.col("units_ref") + F.when(cov, F.col("inc_cum")).otherwise(0.0)
    return rows.select(
        "series_key", "period",
        F.when(use, new).otherwise(F.col("units")).alias("units"), "units_trend",
        F.when(use & cov, "premissa_engenharia").otherwise(F.col("method")).alias("method"),
    )


def agg_units_group(units: DataFrame, keys: DataFrame, groupings: Sequence[str], gp, hist_end: date) -> DataFrame:
    """Units per model series; the method is the most frequent one."""
    now = keys.where(F.col("period") == F.lit(hist_end))
    member = prj_grouping(now, groupings, gp).select("series_key", *GROUPED)
    rows = units.join(member, "series_key")
    by = rows.groupBy(*GROUPED, "period", "method").agg(
        F.count("*").alias("c"), F.sum("units").alias("u"), F.sum("units_trend").alias("ut")
    )
    first = F.struct((-F.col("c")).alias("c"), "method")
    return by.groupBy(*GROUPED, "period").agg(
        F.min_by("method", first).alias("method"), F.sum("u").alias("units"), F.sum("ut").alias("units_trend")
    )


def fc_volume(
    grid: DataFrame, forecasts: DataFrame, fallback: DataFrame, info: DataFrame, units: DataFrame, factors: DataFrame
) -> DataFrame:
    """Projected volume per series x month x scenario.

    ``grid`` carries the chosen model; consumption models multiply by the units,
    volume models imply a consumption.
    """
    rows = (
        grid.join(forecasts, [*GROUPED, "model", "period", "scenario"], "left")
        .join(fallback.select(*GROUPED, "period", "consumption_fb"), [*GROUPED, "period"], "left")
        .join(info.select(*GROUPED, "eligible"), GROUPED, "left")
        .join(units, [*GROUPED, "period"], "left")
        .join(factors, ["category_detail", "period"], "left")
    )
    bad = F.col("forecast").isNull() | F.isnan("forecast") | (F.abs("forecast") == F.lit(float("inf")))
    kind = F.when(~F.coalesce("eligible", F.lit(False)), "nao_elegivel").when(bad, "falha_modelo").otherwise("modelo")
    direct = F.col("model").isin(*VOLUME_MODELS)
    model_cons = (
        F.when(kind != "modelo", F.col("consumption_fb"))
        .when(direct, ratio("forecast", "units")).otherwise(F.col("forecast"))
    )
    rows = rows.withColumns({"fallback": kind, "consumption_model": model_cons})
    rows = rows.withColumn("consumption", F.col("consumption_model") * F.col("factor"))
    rows = rows.withColumn("vol", F.col("consumption") * F.col("units"))
    return rows.select(
        *GROUPED, "model", "period", F.lit("PROJ").alias("kind"), "scenario", "units", "units_trend", "consumption_model",
        F.col("factor").alias("tariff_factor"), "consumption", "vol",
        (F.col("consumption_model") * F.col("factor_low") * F.col("units")).alias("vol_eps_low"),
        (F.col("consumption_model") * F.col("factor_high") * F.col("units")).alias("vol_eps_high"),
        F.when(direct, F.col("vol")).otherwise(F.col("consumption") * F.col("units_trend")).alias("vol_units_trend"),
        "fallback", "method",
    )


MEASURES = ["units", "units_trend", "vol", "vol_eps_low", "vol_eps_high", "vol_units_trend"]
RESULT = ["segment", "target", "scenario"]


def agg_mensal(proj: DataFrame, real: DataFrame, scenarios: Sequence[str], segment: str, target: str) -> DataFrame:
    """Monthly result by region x category x territory; history repeats in
    every scenario."""
    s = F.explode(F.array(*[F.lit(x) for x in scenarios])).alias("scenario")
    dims = ["scenario", "region_adj", "category_detail", "territory", "period", "kind"]
    # history folds before it is repeated per scenario
    past = real.groupBy("region_adj", "category_detail", "territory", "period", "kind").agg(
        F.sum("units").alias("units"), F.sum("vol").alias("vol")
    ).select("*", s).withColumns(
        {"vol_eps_low": F.col("vol"), "vol_eps_high": F.col("vol"), "units_trend": F.col("units"), "vol_units_trend": F.col("vol")}
    )
    both = past.unionByName(proj, allowMissingColumns=True)
    rows = both.groupBy(*dims).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in MEASURES])
    return rows.select(
        F.lit(segment).alias("segment"), F.lit(target).alias("target"), *dims, *MEASURES,
        ratio("vol", "units").alias("consumption"),
    )


def agg_annual(monthly: DataFrame) -> DataFrame:
    """Annual volumes at three levels, with changes on the year before."""
    cols = [F.col(c) for c in (*RESULT, "period", "region_adj", "category_detail")]
    head = [F.col(c) for c in (*RESULT, "period")]
    fine = monthly.groupBy(*RESULT, "period", "region_adj", "category_detail").agg(
        *[F.sum(c).alias(c) for c in MEASURES], F.max((F.col("kind") == "PROJ").cast("int")).alias("is_proj")
    )
    sets = [head, [*head, F.col("category_detail")], [*head, F.col("region_adj")]]
    cube = fine.groupingSets(sets, *cols).agg(
        F.grouping("region_adj").alias("_r"), F.grouping("category_detail").alias("_c"),
        *[F.sum(c).alias(c) for c in MEASURES], F.max("is_proj").alias("is_proj"),
    )
    level = F.when(F.col("_r") == 0, "superintendencia").when(F.col("_c") == 0, "categoria").otherwise("total")
    keys = [*RESULT, "level", "region_adj", "category_detail"]
    year = cube.withColumn("level", level).groupBy(*keys, F.year("period").alias("year")).agg(
        *[F.sum(c).alias(c) for c in ("vol", "vol_eps_low", "vol_eps_high", "vol_units_trend")],
        F.avg("units").alias("units_mean"), F.avg("units_trend").alias("units_trend_mean"),
        F.sum("is_proj").alias("projected_months"),
    )
    year = year.withColumn("consumption_mean", ratio("vol", "units_mean") / 12)
    return win_yoy(year, keys, {"vol": "var_vol", "units_mean": "var_units", "consumption_mean": "var_consumption"})


def win_yoy(rows: DataFrame, keys: Sequence[str], cols: dict[str, str], order: str = "year") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumns({out: ratio(c, F.lag(c).over(w)) - 1 for c, out in cols.items()})


def agg_imputed_share(monthly: DataFrame) -> DataFrame:
    v = F.col("vol")
    return monthly.where(F.col("kind") != "PROJ").groupBy(*RESULT, "period").agg(
        ratio(F.sum(F.when(F.col("kind") == "IMPUTADO", v).otherwise(0.0)), F.sum(v)).alias("imputed_share"),
        F.sum(v).alias("vol"),
    )


def agg_premise_mix(premise: DataFrame) -> DataFrame:
    """Municipalities and increments by usage x type."""
    by = premise.groupBy("usage", "type", "municipality").agg(F.sum("increment").alias("i"))
    return by.groupBy("usage", "type").agg(F.count("*").alias("municipalities"), F.sum("i").alias("increment"))


def premise_allocated(alloc: DataFrame, keys: DataFrame) -> DataFrame:
    place = keys.select("series_key", "region_adj", "category_detail", "territory").distinct()
    return alloc.join(place, "series_key").groupBy("region_adj", "category_detail", "territory", "period", "rule").agg(
        F.sum("increment").alias("increment")
    )


def chosen_series(info: DataFrame, choice: DataFrame) -> DataFrame:
    """Active series of each category's chosen grouping, with its model."""
    pick = choice.select("category_detail", "grouping", "model")
    return info.where("active").select(*GROUPED).join(pick, ["category_detail", "grouping"])


def project_grid(series: DataFrame, hist_end: date, last: date, scenarios: Sequence[str]) -> DataFrame:
    months = F.explode(F.sequence(F.lit(shift_date(hist_end, 1)), F.lit(last), F.expr("interval 1 month"))).alias("period")
    s = F.explode(F.array(*[F.lit(x) for x in scenarios])).alias("scenario")
    return series.select(*GROUPED, "model", months).select("*", s)

"""Model series: cleaning, peaks, groupings, holes, eligibility."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.dates import month_index, shift
from ..functions.numeric import median, ratio, weighted_mean
from ..functions.windows import complete_months, fill_both, interpolate, interpolate_months, over_time, run_id
from ..params import BacktestParams, GroupingParams
from ..rules import OTHERS, TARGETS
from ..schemas import MODEL_SERIES

SERIES_ATTRS = [
    "series_key", "region", "region_adj", "municipality", "office", "category_detail", "territory", "abc_class",
]
GROUPED = ["grouping", *MODEL_SERIES]
EXOG = ["prec_tot", "temp_med", "jobs"]
SUM_PREFIXES = ("vol_", "units_", "conns_", "n_bills", "days")


def agg_sum_na(base: DataFrame) -> DataFrame:
    """Size classes of a series month in one row: sums (NULL if all are NULL),
    first value of the other columns, which do not differ."""
    keys = [
        "series_key", "region", "municipality", "ibge_code", "office", "category", "category_detail", "territory",
        "abc_class", "period",
    ]
    sums = [c for c in base.columns if c.startswith(SUM_PREFIXES)]
    rest = [c for c in base.columns if c not in {*keys, *sums, "size_class"}]
    return base.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in rest]
    )


def prj_size_mode(base: DataFrame, mode: str) -> DataFrame:
    """'sum' adds both size classes; 'others' leaves the large accounts out."""
    return agg_sum_na(base.where(F.col("size_class") == OTHERS) if mode == "others" else base)


def prj_category_cut(base: DataFrame, categories: Sequence[str]) -> DataFrame:
    return base.where(F.col("category").isin(*categories))


def prj_region_adj(base: DataFrame, g: GroupingParams) -> DataFrame:
    capital = F.col("municipality") == g.capital
    adj = F.when(capital, F.concat(F.lit(g.capital_prefix), F.col("region"))).otherwise(F.col("region"))
    return base.withColumn("region_adj", adj)


def model_base(base: DataFrame, b: BacktestParams, g: GroupingParams) -> DataFrame:
    return prj_region_adj(prj_size_mode(prj_category_cut(base, b.categories), b.size_mode), g)


def ts_exog_fill(base: DataFrame) -> DataFrame:
    """Exogenous values per municipality on the whole calendar, without holes."""
    known = base.groupBy("municipality", "period").agg(*[F.max(c).alias(c) for c in EXOG])
    span = base.agg(F.min("period").alias("a"), F.max("period").alias("b"))
    months = F.explode(F.sequence("a", "b", F.expr("interval 1 month")))
    grid = known.select("municipality").distinct().crossJoin(F.broadcast(span)).select(
        "municipality", months.alias("period")
    )
    return interpolate_months(grid.join(known, ["municipality", "period"], "left"), ["municipality"], EXOG)


def ts_tariff(base: DataFrame) -> DataFrame:
    """Tariff per category x month; ``n_values`` above 1 means it is not unique."""
    return base.groupBy("category_detail", "period").agg(
        F.max("real_tariff").alias("tariff"), F.countDistinct("real_tariff").alias("n_values")
    )


def prj_null_drop(base: DataFrame, target: str) -> DataFrame:
    vol, units = TARGETS[target]
    return base.where(F.col(vol).isNotNull() & F.col(units).isNotNull() & (F.col(units) > 0))


# Cleaning: months on each side of a local level, rounds of reweighting, and the remainders beyond which a month has no weight, in
# median absolute remainders.
SIDE, REWEIGHTS, REACH = 6, 2, 6.0


def ts_clean(df: DataFrame, key: str, value: str, out: str, inside: Column, treat: bool) -> DataFrame:
    """Robust cleaning of one monthly column of each key, where ``inside``.

    Non-positive values are missing; with fewer than four points nothing else happens.  On the log scale the series is split into
    trend, season and remainder, iteratively reweighted.  The first trend is a window median, which outliers do not move while they
    are a minority of its window; the season is the median of each calendar month (from 25 months on).  Then each round weighs the
    months by the bisquare of their remainder, so that what looks like an outlier has no part in the next trend, and its neighbours
    are not dragged along.  A remainder outside Q1 - 3 IQR .. Q3 + 3 IQR is missing in the end.  Missing points come from the
    neighbours, season put aside.  Every window shares the key's partition.
    """
    x = F.when(F.col(value) > 0, F.col(value))
    w = Window.partitionBy(key, "_in")
    wt = w.orderBy("period")
    near = wt.rowsBetween(-SIDE, SIDE)
    month = Window.partitionBy(key, "_in", F.month("period"))
    half = F.lit(0.5)
    t = month_index("period").cast("double")
    df = df.withColumns({"_in": F.coalesce(inside, F.lit(False)), "_x": x, "_t": t})
    df = df.withColumns({"_n": F.count("*").over(w), "_obs": F.count("_x").over(w), "_l": F.ln("_x")})
    df = df.withColumn("_f", interpolate("_l", wt, "_t"))
    df = df.withColumn("_tr", F.percentile("_f", half).over(near))
    for k in range(REWEIGHTS + 1):
        df = df.withColumn("_d", F.col("_l") - F.col("_tr"))
        df = df.withColumn("_s", F.when(F.col("_n") >= 25, F.coalesce(F.percentile("_d", half).over(month), F.lit(0.0))).otherwise(0.0))
        df = df.withColumn("_r", F.col("_d") - F.col("_s"))
        if k == REWEIGHTS:
            break
        df = df.withColumn("_u", F.abs("_r") / (REACH * F.percentile(F.abs("_r"), half).over(w) + 1e-9))
        df = df.withColumn("_w", F.when(F.col("_u") < 1, F.pow(1 - F.col("_u") * F.col("_u"), F.lit(2.0))).otherwise(0.0))
        level = F.sum(F.col("_w") * (F.col("_f") - F.col("_s"))).over(near)
        df = df.withColumn("_tr", F.coalesce(F.try_divide(level, F.sum("_w").over(near)), F.col("_tr")))
    if treat:
        q1, q3 = F.percentile("_r", F.lit(0.25)).over(w), F.percentile("_r", F.lit(0.75)).over(w)
        df = df.withColumns({"_q1": q1, "_q3": q3})
        far = 3 * (F.col("_q3") - F.col("_q1")) + 1e-9
        bad = (F.col("_r") < F.col("_q1") - far) | (F.col("_r") > F.col("_q3") + far)
        df = df.withColumn("_ok", F.when(~bad, F.col("_l") - F.col("_s")))
    else:
        df = df.withColumn("_ok", F.col("_l") - F.col("_s"))
    df = df.withColumn("_z", interpolate("_ok", wt, "_t"))
    rebuilt = F.when(F.col("_ok").isNotNull(), F.col("_x")).otherwise(F.exp(F.col("_z") + F.col("_s")))
    cleaned = F.when(F.col("_in") & (F.col("_obs") >= 4), rebuilt).otherwise(F.col("_x"))
    return df.withColumn(out, cleaned).drop(*[c for c in df.columns if c.startswith("_")])


def ts_key_prep(base: DataFrame, target: str, clean_to: date, treat: bool, clean_units: bool) -> DataFrame:
    """Series of one target with consumption per unit cleaned up to a month.

    Inner holes exist only for the cleaning and leave again.
    """
    vol, units = TARGETS[target]
    rows = prj_null_drop(base, target).select(*SERIES_ATTRS, "period", F.col(vol).alias("vol"), F.col(units).alias("units"))
    rows = complete_months(rows, SERIES_ATTRS).withColumn("consumption", F.col("vol") / F.col("units"))
    inside = F.col("period") <= F.lit(clean_to)
    rows = ts_clean(rows, "series_key", "consumption", "consumption_adj", inside, treat)
    if clean_units:
        rows = ts_clean(rows, "series_key", "units", "units_adj", inside, True)
    else:
        rows = rows.withColumn("units_adj", F.col("units"))
    rows = rows.where(F.col("units").isNotNull())
    rows = rows.withColumns(
        {
            "units_adj": F.coalesce("units_adj", "units"),
            "consumption_adj": F.coalesce("consumption_adj", "consumption"),
        }
    )
    rows = rows.withColumn("vol_adj", F.coalesce(F.col("units_adj") * F.col("consumption_adj"), F.col("vol")))
    changed = F.abs(F.col("consumption_adj") - F.col("consumption")) > 1e-8 * F.greatest(F.lit(1.0), F.abs("consumption"))
    return rows.withColumn("outlier", changed)


def ts_peaks(keys: DataFrame, train_end: date, factor: float, max_months: int) -> DataFrame:
    """Test months far above the last year's median that come back to normal.

    Returns the series with ``peak`` and ``vol_ref``; a peak's actual volume is
    the median.  Longer runs, or runs that reach the last month, stay.
    """
    recent = (F.col("period") <= F.lit(train_end)) & (F.col("period") > shift(F.lit(train_end), -12))
    w = Window.partitionBy("series_key")
    ref = F.percentile(F.when(recent, F.col("vol")), F.lit(0.5)).over(w)
    rows = keys.withColumn("vol_ref", ref)
    above = (
        (F.col("period") > F.lit(train_end)) & (F.coalesce("vol_ref", F.lit(0.0)) > 0)
        & (F.col("vol") > factor * F.col("vol_ref"))
    )
    rows = rows.withColumn("_above", above)
    rows = rows.withColumn("_run", run_id("_above", over_time(["series_key"])))
    block = Window.partitionBy("series_key", "_run")
    rows = rows.withColumns({"_len": F.count("*").over(block), "_end": F.max("period").over(block)})
    last = keys.agg(F.max("period").alias("_last"))
    peak = F.col("_above") & (F.col("_len") <= max_months) & (F.col("_end") < F.col("_last"))
    rows = rows.crossJoin(F.broadcast(last)).withColumn("peak", F.coalesce(peak, F.lit(False)))
    fixed = {
        "vol_original": F.col("vol"),
        "vol": F.when(F.col("peak"), F.col("vol_ref")).otherwise(F.col("vol")),
        "vol_adj": F.when(F.col("peak"), F.col("vol_ref")).otherwise(F.col("vol_adj")),
    }
    return rows.withColumns(fixed).drop("_above", "_run", "_len", "_end", "_last")


def peak_list(peaked: DataFrame) -> DataFrame:
    return peaked.where("peak").select(
        "series_key", "region_adj", "category_detail", "territory", "period", "vol_original",
        F.col("vol_ref").alias("vol_median_12m"), ratio("vol_original", "vol_ref").alias("ratio"),
        (F.col("vol_original") - F.col("vol_ref")).alias("excess"),
    )


def agg_outlier_summary(keys: DataFrame, clean_to: date) -> DataFrame:
    window = F.when(F.col("period") <= F.lit(clean_to), "train").otherwise("test")
    return keys.groupBy(window.alias("window")).agg(
        F.avg(F.col("outlier").cast("double")).alias("share_adjusted"),
        (ratio(F.sum("vol_adj"), F.sum("vol")) - 1).alias("volume_change"),
    )


def agg_raw_vs_clean(keys: DataFrame) -> DataFrame:
    """Mean consumption, raw and cleaned, in long form."""
    g = keys.groupBy("period", "category_detail").agg(
        ratio(F.sum("vol"), F.sum("units")).alias("Bruto"), ratio(F.sum("vol_adj"), F.sum("units_adj")).alias("Ajustado")
    )
    return g.unpivot(["period", "category_detail"], ["Bruto", "Ajustado"], "kind", "consumption")


# -- groupings --------------------------------------------------------------


def grouping_rules(g: GroupingParams) -> dict[str, Callable[[], Column]]:
    """Grouping name -> Column.  Every rule keeps region, detail and territory."""
    city = F.col("municipality")
    by_office = city.isin(*g.by_office)
    with_office = F.concat(city, F.lit("_"), F.col("office").cast("string"))
    return {
        "G1_municipioA_clusterBC": lambda: F.when(by_office, with_office).when(F.col("abc_class") == "A", city).otherwise(
            F.concat(F.lit("cluster_"), F.col("region"))
        ),
        "G2_superintendencia": lambda: F.col("region_adj"),
        "G3_municipio": lambda: F.when(by_office, with_office).otherwise(city),
    }


def prj_grouping(keys: DataFrame, names: Sequence[str], g: GroupingParams) -> DataFrame:
    """One row per grouping: all groupings run as one job."""
    rules = grouping_rules(g)
    pairs = F.array(*[F.struct(F.lit(n).alias("grouping"), rules[n]().alias("group")) for n in names])
    return keys.withColumn("_g", F.explode(pairs)).select("*", "_g.grouping", "_g.group").drop("_g")


def jn_many(grouped: DataFrame, exog: DataFrame) -> DataFrame:
    """Municipalities of each group x their monthly exogenous values."""
    return grouped.select(*GROUPED, "municipality").distinct().join(
        exog.select("municipality", "period", "jobs"), "municipality"
    )


def agg_group_jobs(grouped: DataFrame, exog: DataFrame) -> DataFrame:
    """Jobs of a group: sum over its distinct municipalities, a fixed set."""
    return jn_many(grouped, exog).groupBy(*GROUPED, "period").agg(F.sum("jobs").alias("jobs"))


def agg_group_series(grouped: DataFrame, exog: DataFrame) -> DataFrame:
    rows = grouped.join(exog.select("municipality", "period", "prec_tot", "temp_med"), ["municipality", "period"], "left")
    w = F.col("units_adj")
    by_city = rows.groupBy(*GROUPED, "period", "municipality").agg(
        *[F.sum(F.col(c) * w).alias(f"x_{c}") for c in ("prec_tot", "temp_med")],
        *[F.sum(F.when(F.col(c).isNotNull(), w)).alias(f"w_{c}") for c in ("prec_tot", "temp_med")],
        F.sum("vol_adj").alias("vol_adj"), F.sum("vol").alias("vol_raw"),
        F.sum("units_adj").alias("units_adj"), F.sum("units").alias("units_raw"),
        F.count("*").alias("n_keys"),
    )
    return by_city.groupBy(*GROUPED, "period").agg(
        *[ratio(F.sum(f"x_{c}"), F.sum(f"w_{c}")).alias(c) for c in ("prec_tot", "temp_med")],
        *[F.sum(c).alias(c) for c in ("vol_adj", "vol_raw", "units_adj", "units_raw", "n_keys")],
        F.count("*").alias("n_municipalities"),
    )


def ts_group(grouped: DataFrame, exog: DataFrame) -> DataFrame:
    """Model series: group sums on a full month axis, holes interpolated except
    the volume, which stays NULL there (``filled``)."""
    rows = complete_months(agg_group_series(grouped, exog), GROUPED)
    rows = rows.join(agg_group_jobs(grouped, exog), [*GROUPED, "period"], "left")
    consumption = ratio("vol_adj", "units_adj")
    rows = rows.withColumns(
        {"filled": F.col("vol_adj").isNull(), "consumption": F.when(consumption > 0, consumption)}
    )
    rows = interpolate_months(rows, GROUPED, ["consumption", "units_adj", *EXOG])
    return rows.withColumn("volume", F.col("consumption") * F.col("units_adj"))


def agg_series_info(ts: DataFrame, hist_end: date, min_obs: int) -> DataFrame:
    """History, last month, last-year volume, and whether a model may be fitted."""
    past = F.col("period") <= F.lit(hist_end)
    recent = past & (F.col("period") > shift(F.lit(hist_end), -12))
    info = ts.groupBy(*GROUPED).agg(
        F.count_if(past & F.col("consumption").isNotNull()).alias("n_hist"),
        F.max(F.when(past, F.col("period"))).alias("last_hist"),
        F.coalesce(F.sum(F.when(recent, F.col("vol_raw"))), F.lit(0.0)).alias("vol_12m"),
    )
    active = F.coalesce(F.col("last_hist") == F.lit(hist_end), F.lit(False))
    return info.withColumn("active", active).withColumn("eligible", F.col("active") & (F.col("n_hist") >= min_obs))


def jn_semi_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys.select(*GROUPED), GROUPED, "left_semi")


def agg_series_counts(info: DataFrame) -> DataFrame:
    v, closed, short = F.col("vol_12m"), ~F.col("active"), F.col("active") & ~F.col("eligible")
    return info.groupBy("grouping", "category_detail").agg(
        F.count("*").alias("n_series"),
        F.count_if("eligible").alias("n_eligible"),
        F.count_if(closed).alias("n_closed"),
        ratio(F.sum(F.when(closed, v).otherwise(0.0)), F.sum(v)).alias("share_closed"),
        F.count_if(short).alias("n_fallback"),
        ratio(F.sum(F.when(short, v).otherwise(0.0)), F.sum(v)).alias("share_fallback"),
    )


def ts_impute_hist(ts: DataFrame, hist_end: date, max_run: int) -> DataFrame:
    """History for the projection: short holes are imputed, long ones dropped."""
    rows = ts.where(F.col("period") <= F.lit(hist_end))
    rows = rows.withColumn("_run", run_id("filled", over_time(GROUPED)))
    size = F.count("*").over(Window.partitionBy(*GROUPED, "_run"))
    rows = rows.withColumn("_len", F.when(F.col("filled"), size).otherwise(0)).where(F.col("_len") <= max_run)
    hole = F.col("filled")
    units = F.when(hole, F.col("units_adj")).otherwise(F.col("units_raw"))
    vol = F.when(hole, F.col("consumption") * F.col("units_adj")).otherwise(F.col("vol_raw"))
    return rows.select(
        *GROUPED, "period", F.when(hole, "IMPUTADO").otherwise("REAL").alias("kind"), units.alias("units"),
        vol.alias("vol"), ratio(vol, units).alias("consumption"),
    )


# Separator inside the text of a row, the mark of NULL, and the modulus of the sums.
UNIT_SEPARATOR, NULL_MARK, MODULUS = "\x1f", "\x1e", 1 << 60
HASHES = ("a", "b")


def row_text(df: DataFrame, digits: int) -> Column:
    """All columns of a row as one text; numbers with so many decimals, as sums of doubles differ beyond them from run to run."""
    cells = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("double", "float", "decimal"):
            c = F.round(c.try_cast(f"decimal(38,{digits + 4})"), digits).cast(f"decimal(38,{digits})")
        cells.append(F.coalesce(c.cast("string"), F.lit(NULL_MARK)))
    return F.concat_ws(UNIT_SEPARATOR, *cells)


def ts_fingerprint(train: DataFrame, formulas: dict[str, str], digits: int = 4) -> DataFrame:
    """Signature of each series of a training set, and of its models.

    A series is a multiset of rows.  Each row has two hashes (60 bits each of the MD5 of its text, key and month included), and the
    series keeps their sums and their exclusive ors.  Any changed, moved, lost or repeated row shows, whatever the order, and the
    signatures of parts merge (``merge_fingerprints``), so one pass with map-side combination is enough.
    """
    text = " | ".join(f"{k}: {v}" for k, v in sorted(formulas.items()))
    digest = F.md5(row_text(train, digits).cast("binary"))
    hashed = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("long").alias(f"_{h}") for i, h in enumerate(HASHES)]
    rows = train.select(*GROUPED, *hashed)
    return rows.groupBy(*GROUPED).agg(F.lit(1).cast("long").alias("n_series"), F.count("*").alias("n_rows"), *_hash_sums("_{}", "_{}")).withColumn("formulas", F.lit(text))


def _hash_sums(sums: str, xors: str) -> list[Column]:
    out = []
    for h in HASHES:
        total = F.pmod(F.sum(F.col(sums.format(h)).cast("decimal(20,0)")), F.lit(MODULUS).cast("decimal(20,0)"))
        out += [total.cast("long").alias(f"sum_{h}"), F.bit_xor(xors.format(h)).alias(f"xor_{h}")]
    return out


def merge_fingerprints(fingerprints: DataFrame, by: Sequence[str]) -> DataFrame:
    """Signature of each group of series: the same as of all their rows at once."""
    counts = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_series", "n_rows")]
    return fingerprints.groupBy(*by).agg(*counts, *_hash_sums("sum_{}", "xor_{}"), F.max("formulas").alias("formulas"))


def win_filldir(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    w = over_time(["series_key"])
    return rows.withColumns({c: fill_both(c, w) for c in cols})


def win_lag_cols(ts: DataFrame) -> DataFrame:
    """Statewide consumption with its value of the month before.  One row per
    month of calendar, so the ordered window stays small."""
    g = ts.groupBy("period").agg(ratio(F.sum("vol_raw"), F.sum("units_raw")).alias("level"))
    w = Window.partitionBy(F.lit(0)).orderBy("period")
    return g.withColumn("lag_level", F.lag("level").over(w))

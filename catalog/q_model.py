"""Queries: model series, scenarios, fallback, units, tariff."""

from pyspark.sql import functions as F

from metermill import rules
from metermill.operators import forecast as fcs
from metermill.operators import series
from metermill.operators.series import EXOG, GROUPED

from . import oracle_series as o
from . import stages as st
from .q_series import rounded
from .registry import out, query
from .sqlkit import P, big, cte, d, inlist, lit, r, values

BT, GP, PJ = P.backtest, P.grouping, P.projection
CUT = BT.cut
TRAIN = fcs.shift_date(CUT, -1)
TEST_END = fcs.shift_date(CUT, BT.horizon - 1)
HIST = TEST_END  # the projection starts after the last test month
K5 = 'grouping, region_adj, "group", category_detail, territory'
ATTRS = "series_key, region, region_adj, municipality, office, category_detail, territory, abc_class"


def interp(x, part, t="t"):
    """Linear inside, constant outside (independent formulation)."""
    pre = f"OVER (PARTITION BY {part} ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    fol = f"OVER (PARTITION BY {part} ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    tt = f"CASE WHEN {x} IS NOT NULL THEN {t} END"
    x0, t0 = f"last_value({x} IGNORE NULLS) {pre}", f"last_value({tt} IGNORE NULLS) {pre}"
    x1, t1 = f"first_value({x} IGNORE NULLS) {fol}", f"first_value({tt} IGNORE NULLS) {fol}"
    return f"coalesce({x}, {x0} + ({x1} - {x0}) * ({t} - {t0}) / nullif({t1} - {t0}, 0), {x0}, {x1})"


MSUM = [*o.ORDER]
cte("mbase", f"""
SELECT series_key, region, municipality, ibge_code, office, category, category_detail, territory, abc_class, period,
  {", ".join(f"sum({c}) AS {c}" for c in MSUM)}, bool_or(rebalanced) AS rebalanced, max(prec_tot) AS prec_tot, max(temp_med) AS temp_med,
  max(jobs) AS jobs, max(real_tariff) AS real_tariff,
  CASE WHEN municipality = {lit(GP.capital)} THEN {lit(GP.capital_prefix)} || region ELSE region END AS region_adj
FROM base WHERE category IN {inlist(BT.categories)} GROUP BY ALL""")
cte("exog_grid", """
SELECT m.municipality, CAST(p AS DATE) AS period, prec_tot, temp_med, jobs, CAST(year(p) * 12 + month(p) AS DOUBLE) AS t
FROM (SELECT DISTINCT municipality FROM mbase) m
CROSS JOIN (SELECT unnest(generate_series((SELECT min(period) FROM mbase), (SELECT max(period) FROM mbase), INTERVAL 1 MONTH)) AS p)
LEFT JOIN (SELECT DISTINCT municipality, period, prec_tot, temp_med, jobs FROM mbase) x ON x.municipality = m.municipality AND x.period = p""")
cte("exog", f"SELECT municipality, period, {', '.join(interp(c, 'municipality') + f' AS {c}' for c in EXOG)} FROM exog_grid")


@query("agg_sum_na", f"""
SELECT series_key, period, {r("sum(vol_meas_water)", 4)} AS vol_meas_water, {r("sum(units_water)", 4)} AS units_water, {r("max(jobs)", 2)} AS jobs
FROM base GROUP BY 1, 2""")
def _(ws):
    g = series.agg_sum_na(st.base(ws)).select("series_key", "period", "vol_meas_water", "units_water", "jobs")
    return out(g, jobs=2)


@query("prj_size_mode", f"""
SELECT series_key, period, {r("sum(vol_meas_water)", 4)} AS vol_meas_water, {r("sum(units_water)", 4)} AS units_water FROM base WHERE size_class = 'Demais' GROUP BY 1, 2""")
def _(ws):
    return out(series.prj_size_mode(st.base(ws), "others").select("series_key", "period", "vol_meas_water", "units_water"))


@query("prj_category_cut", "SELECT category_detail, count(*) AS n FROM base WHERE category IN ('Residencial') GROUP BY 1")
def _(ws):
    return series.prj_category_cut(st.base(ws), ["Residencial"]).groupBy("category_detail").agg(F.count("*").alias("n"))


@query("prj_region_adj", "SELECT municipality, region, region_adj, count(*) AS n FROM mbase GROUP BY ALL")
def _(ws):
    return series.model_base(st.base(ws), ws.params.backtest, ws.params.grouping).groupBy(
        "municipality", "region", "region_adj"
    ).agg(F.count("*").alias("n"))


@query("ts_exog_fill", f"SELECT * {rounded(EXOG)} FROM exog")
def _(ws):
    return out(series.ts_exog_fill(st.mbase(ws)))


@query("win_interp", f"SELECT municipality, period, {r('jobs', 3)} AS jobs FROM exog")
def _(ws):
    return out(series.ts_exog_fill(st.mbase(ws)).select("municipality", "period", "jobs"), 3)


@query("ts_tariff", f"""
SELECT category_detail, period, {r("max(real_tariff)", 6)} AS tariff, count(DISTINCT real_tariff) AS n_values FROM mbase GROUP BY 1, 2""")
def _(ws):
    return out(series.ts_tariff(st.mbase(ws)), 6)


@query("prj_null_drop", f"""
SELECT series_key, period, {r("vol_meas_sewage", 4)} AS vol_meas_sewage, {r("units_sewage", 4)} AS units_sewage FROM mbase
WHERE vol_meas_sewage IS NOT NULL AND units_sewage > 0""")
def _(ws):
    rows = series.prj_null_drop(st.mbase(ws), "med_esg")
    return out(rows.select("series_key", "period", "vol_meas_sewage", "units_sewage"))


# -- cleaning ---------------------------------------------------------------

cte("k_rows", f"SELECT {ATTRS}, period, vol_meas_water AS vol, units_water AS units FROM mbase WHERE vol_meas_water IS NOT NULL AND units_water > 0")
cte("k_full", f"""
SELECT s.*, k.vol, k.units, k.vol / k.units AS consumption, s.period <= {lit(TRAIN)} AS inside
FROM (SELECT {ATTRS}, CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS DATE) AS period FROM k_rows GROUP BY {ATTRS}) s
LEFT JOIN k_rows k USING (series_key, period)""")
SI = "series_key, inside"
cte("c1", f"""
SELECT *, CAST(year(period) * 12 + month(period) AS DOUBLE) AS t, CASE WHEN consumption > 0 THEN consumption END AS x,
  ln(CASE WHEN consumption > 0 THEN consumption END) AS l,
  count(*) OVER (PARTITION BY {SI}) AS n, count(CASE WHEN consumption > 0 THEN 1 END) OVER (PARTITION BY {SI}) AS obs FROM k_full""")
cte("c2", f"SELECT *, {interp('l', SI)} AS f FROM c1")
NEAR = f"PARTITION BY {SI} ORDER BY period ROWS BETWEEN {series.SIDE} PRECEDING AND {series.SIDE} FOLLOWING"


def reweighted(src, last):
    """The rounds of the decomposition, one expression each, up to ``last``: dt, s of the round and the next trend."""
    cte("cr0", f"SELECT *, quantile_cont(f, 0.5) OVER ({NEAR}) AS tr FROM {src}")
    for k in range(series.REWEIGHTS + 1):
        cte(f"cs{k}", f"""
SELECT *, l - tr AS dt, CASE WHEN n >= 25 THEN coalesce(quantile_cont(l - tr, 0.5) OVER (PARTITION BY {SI}, month(period)), 0) ELSE 0 END AS s FROM cr{k}""")
        if k == series.REWEIGHTS:
            break
        cte(f"cu{k}", f"SELECT *, abs(dt - s) / ({series.REACH} * quantile_cont(abs(dt - s), 0.5) OVER (PARTITION BY {SI}) + 1e-9) AS u FROM cs{k}")
        cte(f"cw{k}", f"SELECT *, CASE WHEN u < 1 THEN pow(1 - u * u, 2) ELSE 0 END AS w FROM cu{k}")
        cte(f"cr{k + 1}", f"""
SELECT * EXCLUDE (tr, dt, s, u, w), coalesce(sum(w * (f - s)) OVER ({NEAR}) / nullif(sum(w) OVER ({NEAR}), 0), tr) AS tr FROM cw{k}""")
    cte(last, f"SELECT * FROM cs{series.REWEIGHTS}")


reweighted("c2", "c4")
cte("c5", f"""
SELECT *, dt - s AS rem, quantile_cont(dt - s, 0.25) OVER (PARTITION BY {SI}) AS q1, quantile_cont(dt - s, 0.75) OVER (PARTITION BY {SI}) AS q3 FROM c4""")
cte("c6", "SELECT *, CASE WHEN rem BETWEEN q1 - 3 * (q3 - q1) - 1e-9 AND q3 + 3 * (q3 - q1) + 1e-9 THEN l - s END AS ok FROM c5")
cte("c7", f"SELECT *, {interp('ok', SI)} AS z FROM c6")
cte("keys0", f"""
SELECT {ATTRS}, period, vol, units, consumption, units AS units_adj,
  coalesce(CASE WHEN inside AND obs >= 4 THEN CASE WHEN ok IS NOT NULL THEN x ELSE exp(z + s) END ELSE x END, consumption) AS consumption_adj
FROM c7 WHERE units IS NOT NULL""")
cte("keys1", """
SELECT *, coalesce(units_adj * consumption_adj, vol) AS vol_adj,
  abs(consumption_adj - consumption) > 1e-8 * greatest(1, abs(consumption)) AS outlier FROM keys0""")
KEYD = ["vol", "units", "consumption", "consumption_adj", "units_adj", "vol_adj"]


@query("ts_clean", f"SELECT series_key, period, {r('consumption', 5)} AS consumption, {r('consumption_adj', 5)} AS consumption_adj FROM keys1 WHERE outlier")
def _(ws):
    b = ws.params.backtest
    k = series.ts_key_prep(st.mbase(ws), "med_agua", st.train_end(ws), b.treat_outliers, b.clean_units)
    return out(k.where("outlier").select("series_key", "period", "consumption", "consumption_adj"), 5)


@query("ts_key_prep", f"SELECT {ATTRS}, period, {', '.join(r(c, 4) + f' AS {c}' for c in KEYD)}, outlier FROM keys1")
def _(ws):
    b = ws.params.backtest
    k = series.ts_key_prep(st.mbase(ws), "med_agua", st.train_end(ws), b.treat_outliers, b.clean_units)
    return out(k.select(*series.SERIES_ATTRS, "period", *KEYD, "outlier"))


@query("win_filldir", f"""
SELECT series_key, period, coalesce(
  last_value(x IGNORE NULLS) OVER (PARTITION BY series_key ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(x IGNORE NULLS) OVER (PARTITION BY series_key ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS units
FROM (SELECT series_key, period, CASE WHEN month(period) % 3 = 0 THEN {r("units", 4)} END AS x FROM k_full)""")
def _(ws):
    from metermill.functions.windows import complete_months

    rows = series.prj_null_drop(st.mbase(ws), "med_agua").select("series_key", "period", F.col("units_water").alias("units"))
    rows = complete_months(rows, ["series_key"]).withColumn("units", F.when(F.month("period") % 3 == 0, F.col("units")))
    return out(series.win_filldir(rows, ["units"]))


cte("p1", f"""
SELECT k.*, quantile_cont(vol, 0.5) FILTER (period <= {lit(TRAIN)} AND period > {lit(TRAIN)} - INTERVAL 12 MONTH) OVER (PARTITION BY series_key) AS vol_ref FROM keys1 k""")
cte("p2", f"SELECT *, coalesce(period > {lit(TRAIN)} AND vol_ref > 0 AND vol > {BT.peak_factor} * vol_ref, FALSE) AS above FROM p1")
cte("p3", """
SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY period) - row_number() OVER (PARTITION BY series_key, above ORDER BY period) AS island FROM p2""")
cte("p4", f"""
SELECT *, above AND count(*) OVER (PARTITION BY series_key, above, island) <= {BT.peak_months}
  AND max(period) OVER (PARTITION BY series_key, above, island) < (SELECT max(period) FROM keys1) AS peak FROM p3""")
cte("keys", f"""
SELECT {ATTRS}, period, consumption, units, units_adj, consumption_adj, outlier, vol AS vol_original, vol_ref, peak,
  CASE WHEN peak THEN vol_ref ELSE vol END AS vol, CASE WHEN peak THEN vol_ref ELSE vol_adj END AS vol_adj FROM p4""")


@query("ts_peaks", f"""
SELECT series_key, region_adj, category_detail, territory, period, {r("vol_original", 4)} AS vol_original, {r("vol_ref", 4)} AS vol_median_12m,
  {r("vol_original / vol_ref", 4)} AS ratio, {r("vol_original - vol_ref", 4)} AS excess FROM keys WHERE peak""")
def _(ws):
    return out(series.peak_list(st.peaked(ws)))


@query("win_runs", f"""
SELECT series_key, min(period) AS first, max(period) AS last, count(*) AS len FROM p3 WHERE above GROUP BY series_key, island""")
def _(ws):
    from metermill.functions.windows import over_time, run_id

    b, end = ws.params.backtest, F.lit(st.train_end(ws))
    k = st.peaked(ws)
    above = F.coalesce((F.col("period") > end) & (F.col("vol_ref") > 0) & (F.col("vol_original") > b.peak_factor * F.col("vol_ref")), F.lit(False))
    rows = k.withColumn("above", above).withColumn("run", run_id("above", over_time(["series_key"]))).where("above")
    return rows.groupBy("series_key", "run").agg(
        F.min("period").alias("first"), F.max("period").alias("last"), F.count("*").alias("len")
    ).drop("run")


@query("agg_outlier_summary", f"""
SELECT CASE WHEN period <= {lit(TRAIN)} THEN 'train' ELSE 'test' END AS "window", {r("avg(CASE WHEN outlier THEN 1.0 ELSE 0.0 END)", 6)} AS share_adjusted,
  {r("sum(vol_adj) / nullif(sum(vol), 0) - 1", 6)} AS volume_change FROM keys1 GROUP BY 1""")
def _(ws):
    return out(series.agg_outlier_summary(st.key_rows(ws), st.train_end(ws)), 6)


@query("agg_raw_vs_clean", f"""
SELECT period, category_detail, 'Bruto' AS kind, {r("sum(vol) / nullif(sum(units), 0)", 5)} AS consumption FROM keys1 GROUP BY 1, 2
UNION ALL SELECT period, category_detail, 'Ajustado', {r("sum(vol_adj) / nullif(sum(units_adj), 0)", 5)} FROM keys1 GROUP BY 1, 2""")
def _(ws):
    return out(series.agg_raw_vs_clean(st.key_rows(ws)), 5)


@query("agg_base_mix", f"""
SELECT category_detail, territory, {r("sum(vol_meas_water)", 3)} AS vol, count(DISTINCT series_key) AS n_series,
  {r("sum(vol_meas_water) / sum(sum(vol_meas_water)) OVER ()", 6)} AS share FROM mbase GROUP BY 1, 2""")
def _(ws):
    from metermill.operators import reports

    g = reports.agg_base_mix(st.mbase(ws))
    return out(g, 6, vol=3)


# -- groupings --------------------------------------------------------------

OFF = f"municipality IN {inlist(GP.by_office)}"
cte("gkeys", f"""
SELECT k.*, 'G1_municipioA_clusterBC' AS grouping, CASE WHEN {OFF} THEN municipality || '_' || office WHEN abc_class = 'A' THEN municipality
  ELSE 'cluster_' || region END AS "group" FROM keys k
UNION ALL SELECT k.*, 'G2_superintendencia', region_adj FROM keys k""")


@query("prj_grouping", f"""
SELECT grouping, "group", municipality, count(*) AS n, {r("sum(vol)", 3)} AS vol FROM (SELECT grouping, "group", municipality, vol FROM gkeys
  UNION ALL SELECT 'G3_municipio', CASE WHEN {OFF} THEN municipality || '_' || office ELSE municipality END, municipality, vol FROM keys) GROUP BY 1, 2, 3""")
def _(ws):
    names = list(series.grouping_rules(ws.params.grouping))
    g = series.prj_grouping(st.peaked(ws), names, ws.params.grouping).groupBy("grouping", "group", "municipality")
    return out(g.agg(F.count("*").alias("n"), F.sum("vol").alias("vol")), 3)


cte("gjobs", f"""
SELECT {K5}, period, sum(jobs) AS jobs FROM (SELECT DISTINCT {K5}, municipality FROM gkeys) JOIN exog USING (municipality) GROUP BY {K5}, period""")
cte("gsum", f"""
SELECT {K5}, period, sum(prec_tot * units_adj) / sum(units_adj) FILTER (prec_tot IS NOT NULL) AS prec_tot, sum(temp_med * units_adj) / sum(units_adj) FILTER (temp_med IS NOT NULL) AS temp_med,
  sum(vol_adj) AS vol_adj, sum(vol) AS vol_raw, sum(units_adj) AS units_adj, sum(units) AS units_raw,
  count(DISTINCT series_key) AS n_keys, count(DISTINCT municipality) AS n_municipalities
FROM gkeys LEFT JOIN exog USING (municipality, period) GROUP BY {K5}, period""")
GS = ["prec_tot", "temp_med", "vol_adj", "vol_raw", "units_adj", "units_raw"]


@query("jn_many", f"""
SELECT grouping, "group", category_detail, territory, count(*) AS n, {r("sum(jobs)", 2)} AS jobs FROM (SELECT DISTINCT {K5}, municipality FROM gkeys) JOIN exog USING (municipality) GROUP BY 1, 2, 3, 4""")
def _(ws):
    j = series.jn_many(st.grouped(ws), st.exog(ws)).groupBy("grouping", "group", "category_detail", "territory")
    return out(j.agg(F.count("*").alias("n"), F.sum("jobs").alias("jobs")), 2)


@query("agg_group_jobs", f"SELECT {K5}, period, {r('jobs', 2)} AS jobs FROM gjobs")
def _(ws):
    return out(series.agg_group_jobs(st.grouped(ws), st.exog(ws)), 2)


@query("agg_group_series", f"SELECT * REPLACE ({', '.join(r(c, 4) + f' AS {c}' for c in GS)}, {big('n_keys')} AS n_keys) FROM gsum")
def _(ws):
    return out(series.agg_group_series(st.grouped(ws), st.exog(ws)))


cte("gfull", f"""
SELECT s.*, g.* EXCLUDE ({K5}, period), j.jobs, CASE WHEN vol_adj / nullif(units_adj, 0) > 0 THEN vol_adj / units_adj END AS c0,
  CAST(year(s.period) * 12 + month(s.period) AS DOUBLE) AS t
FROM (SELECT {K5}, CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS DATE) AS period FROM gsum GROUP BY {K5}) s
LEFT JOIN gsum g USING ({K5}, period) LEFT JOIN gjobs j USING ({K5}, period)""")
cte("ts", f"""
SELECT {K5}, period, n_keys, n_municipalities, vol_adj, vol_raw, units_raw, vol_adj IS NULL AS filled, {interp("c0", K5)} AS consumption,
  {", ".join(interp(c, K5) + f" AS {c}" for c in ("units_adj", *EXOG))} FROM gfull""")
TSD = ["prec_tot", "temp_med", "jobs", "vol_adj", "vol_raw", "units_adj", "units_raw", "consumption"]


@query("ts_group", f"SELECT {K5}, period, filled, {', '.join(r(c, 4) + f' AS {c}' for c in TSD)}, {r('consumption * units_adj', 4)} AS volume FROM ts")
def _(ws):
    t = series.ts_group(st.grouped(ws), st.exog(ws))
    return out(t.select(*GROUPED, "period", "filled", *TSD, "volume"))


cte("info", f"""
SELECT *, coalesce(last_hist = {lit(TRAIN)}, FALSE) AS active, coalesce(last_hist = {lit(TRAIN)}, FALSE) AND n_hist >= {BT.min_obs} AS eligible FROM (
  SELECT {K5}, count(*) FILTER (period <= {lit(TRAIN)} AND consumption IS NOT NULL) AS n_hist, max(period) FILTER (period <= {lit(TRAIN)}) AS last_hist,
    coalesce(sum(vol_raw) FILTER (period <= {lit(TRAIN)} AND period > {lit(TRAIN)} - INTERVAL 12 MONTH), 0) AS vol_12m FROM ts GROUP BY {K5})""")


@query("agg_series_info", f"SELECT * REPLACE ({r('vol_12m', 4)} AS vol_12m) FROM info")
def _(ws):
    return out(series.agg_series_info(st.ts(ws), st.train_end(ws), ws.params.backtest.min_obs))


@query("jn_semi_keys", f"SELECT {K5}, period, {r('consumption', 4)} AS consumption FROM ts SEMI JOIN (SELECT * FROM info WHERE eligible) USING ({K5}) WHERE period <= {lit(TRAIN)}")
def _(ws):
    rows = series.jn_semi_keys(st.ts(ws).where(F.col("period") <= F.lit(st.train_end(ws))), st.info(ws).where("eligible"))
    return out(rows.select(*GROUPED, "period", "consumption"))


@query("agg_series_counts", f"""
SELECT grouping, category_detail, count(*) AS n_series, count(*) FILTER (eligible) AS n_eligible, count(*) FILTER (NOT active) AS n_closed,
  {r("coalesce(sum(vol_12m) FILTER (NOT active), 0) / nullif(sum(vol_12m), 0)", 6)} AS share_closed, count(*) FILTER (active AND NOT eligible) AS n_fallback,
  {r("coalesce(sum(vol_12m) FILTER (active AND NOT eligible), 0) / nullif(sum(vol_12m), 0)", 6)} AS share_fallback FROM info GROUP BY 1, 2""")
def _(ws):
    return out(series.agg_series_counts(st.info(ws)), 6)


# text of a row as the fingerprint has it, its two hashes, and their sums per series
CELL = {c: f"coalesce(CAST(CAST(round(TRY_CAST({c} AS DECIMAL(38,8)), 4) AS DECIMAL(38,4)) AS VARCHAR), chr(30))" for c in ("consumption", "units_adj")}
FP_TEXT = "concat_ws(chr(31), " + ", ".join([*(f"coalesce(CAST({c} AS VARCHAR), chr(30))" for c in (*K5.split(", "), "period")), *CELL.values()]) + ")"
HASH60 = " , ".join(f"CAST('0x' || substr(md5({FP_TEXT}), {1 + 15 * i}, 15) AS BIGINT) AS h{h}" for i, h in enumerate(series.HASHES))
FP_SUMS = ", ".join(f"CAST(sum(CAST(h{h} AS HUGEINT)) % {series.MODULUS} AS BIGINT) AS sum_{h}, bit_xor(h{h}) AS xor_{h}" for h in series.HASHES)
FORMULAS = lit(" | ".join(f"{k}: {rules.MODELS[k].formula}" for k in sorted(BT.models)))


@query("ts_fingerprint", f"""
WITH h AS (SELECT {K5}, {HASH60} FROM ts WHERE period <= {lit(TRAIN)})
SELECT 'series' AS level, {K5}, CAST(1 AS BIGINT) AS n_series, count(*) AS n_rows, {FP_SUMS}, {FORMULAS} AS formulas FROM h GROUP BY {K5}
UNION ALL SELECT 'grouping', grouping, NULL, NULL, NULL, NULL, count(DISTINCT ({K5})), count(*), {FP_SUMS}, {FORMULAS} FROM h GROUP BY grouping
UNION ALL SELECT 'all', NULL, NULL, NULL, NULL, NULL, count(DISTINCT ({K5})), count(*), {FP_SUMS}, {FORMULAS} FROM h""")
def _(ws):
    train = st.ts(ws).where(F.col("period") <= F.lit(st.train_end(ws))).select(*GROUPED, "period", "consumption", "units_adj")
    fp = series.ts_fingerprint(train, {m: rules.MODELS[m].formula for m in ws.params.backtest.models})
    res = fp.select(F.lit("series").alias("level"), "*")
    for level, by in (("grouping", ["grouping"]), ("all", [])):
        res = res.unionByName(series.merge_fingerprints(fp, by).select(F.lit(level).alias("level"), "*"), allowMissingColumns=True)
    return res


cte("imp", f"""
SELECT *, CASE WHEN filled THEN count(*) OVER (PARTITION BY {K5}, filled, island) ELSE 0 END AS hole FROM (
  SELECT *, row_number() OVER (PARTITION BY {K5} ORDER BY period) - row_number() OVER (PARTITION BY {K5}, filled ORDER BY period) AS island
  FROM ts WHERE period <= {lit(HIST)})""")
cte("real_hist", f"""
SELECT {K5}, period, CASE WHEN filled THEN 'IMPUTADO' ELSE 'REAL' END AS kind, CASE WHEN filled THEN units_adj ELSE units_raw END AS units,
  CASE WHEN filled THEN consumption * units_adj ELSE vol_raw END AS vol FROM imp WHERE hole <= {PJ.max_imputed_run}""")


@query("ts_impute_hist", f"SELECT {K5}, period, kind, {r('units', 4)} AS units, {r('vol', 4)} AS vol, {r('vol / nullif(units, 0)', 4)} AS consumption FROM real_hist")
def _(ws):
    return out(series.ts_impute_hist(st.ts(ws), st.test_end(ws), ws.params.projection.max_imputed_run))


@query("win_lag_cols", f"""
SELECT period, {r("v / u", 6)} AS level, {r("lag(v / u) OVER (ORDER BY period)", 6)} AS lag_level FROM (
  SELECT period, sum(vol_raw) AS v, nullif(sum(units_raw), 0) AS u FROM ts GROUP BY 1)""")
def _(ws):
    return out(series.win_lag_cols(st.ts(ws)), 6)


# -- scenarios --------------------------------------------------------------

cte("clim", f"""
SELECT {K5}, month(period) AS mon, avg(temp_med) AS temp_mu, coalesce(stddev_samp(temp_med), 0) AS temp_sd, avg(prec_tot) AS prec_mu,
  coalesce(stddev_samp(prec_tot), 0) AS prec_sd, min(prec_tot) AS prec_min FROM ts WHERE period <= {lit(TRAIN)} GROUP BY {K5}, mon""")
CL = ["temp_mu", "temp_sd", "prec_mu", "prec_sd", "prec_min"]


@query("agg_climatology", f"SELECT {K5}, CAST(mon AS INTEGER) AS mon, {', '.join(r(c, 5) + f' AS {c}' for c in CL)} FROM clim")
def _(ws):
    return out(fcs.agg_climatology(st.ts(ws), st.train_end(ws)), 5)


cte("jtrend", f"""
SELECT {K5}, jobs_last, CASE WHEN j13 > 0 THEN pow(jobs_last / j13, 1.0::DOUBLE / 12) - 1 ELSE 0 END AS g FROM (
  SELECT {K5}, arg_max(jobs, period) AS jobs_last, max(CASE WHEN rn = 13 THEN jobs END) AS j13 FROM (
    SELECT *, row_number() OVER (PARTITION BY {K5} ORDER BY period DESC) AS rn FROM ts WHERE period <= {lit(TRAIN)}) GROUP BY {K5})""")


@query("agg_jobs_trend", f"SELECT {K5}, {r('jobs_last', 2)} AS jobs_last, {r('g', 6)} AS g FROM jtrend")
def _(ws):
    return out(fcs.agg_jobs_trend(st.ts(ws), st.train_end(ws)), 6, jobs_last=2)


TESTP = f"period BETWEEN {lit(CUT)} AND {lit(TEST_END)}"
cte("xgrid", f"""
SELECT t.* EXCLUDE (temp_med, prec_tot, jobs), temp_mu, temp_sd, prec_mu, prec_sd, prec_min,
  jobs_last * pow(1 + g, datediff('month', {lit(TRAIN)}, period)) AS jobs FROM (SELECT *, month(period) AS mon FROM ts WHERE {TESTP}) t
LEFT JOIN clim USING ({K5}, mon) LEFT JOIN jtrend USING ({K5})""")
cte("scen", f"""
SELECT {K5}, period, 'base' AS scenario, temp_mu AS temp_med, prec_mu AS prec_tot, jobs FROM xgrid
UNION ALL SELECT {K5}, period, 'quente_seco', temp_mu + temp_sd, greatest(prec_mu - prec_sd, prec_min), jobs FROM xgrid
UNION ALL SELECT {K5}, period, 'frio_umido', greatest(temp_mu - temp_sd, 1), prec_mu + prec_sd, jobs FROM xgrid
UNION ALL SELECT {K5}, period, 'realizado', temp_med, prec_tot, jobs FROM ts WHERE {TESTP}""")
SC = f"SELECT {K5}, period, scenario, {r('temp_med', 4)} AS temp_med, {r('prec_tot', 4)} AS prec_tot, {r('jobs', 2)} AS jobs FROM scen"


def sc_out(df):
    df = df.select(*GROUPED, "period", "scenario", "temp_med", "prec_tot", "jobs")
    return out(df, jobs=2)


@query("sc_exante", SC + " WHERE scenario <> 'realizado'")
def _(ws):
    grid = fcs.sc_realized(st.ts(ws), ws.params.backtest.cut, st.test_end(ws)).select(*GROUPED, "period")
    return sc_out(fcs.sc_exante(st.ts(ws), grid, st.train_end(ws)))


@query("sc_realized", SC + " WHERE scenario = 'realizado'")
def _(ws):
    return sc_out(fcs.sc_realized(st.ts(ws), ws.params.backtest.cut, st.test_end(ws)))


SUMM = f"""
SELECT grouping, scenario, period, {r("sum(temp_med * vol_12m) / nullif(sum(vol_12m) FILTER (temp_med IS NOT NULL), 0)", 5)} AS temp_med,
  {r("sum(prec_tot * vol_12m) / nullif(sum(vol_12m) FILTER (prec_tot IS NOT NULL), 0)", 5)} AS prec_tot, {r("sum(jobs)", 2)} AS jobs
FROM scen LEFT JOIN info USING ({K5}) GROUP BY 1, 2, 3"""


def summ_out(ws):
    return out(fcs.sc_summary(st.scenarios(ws), st.info(ws)), 5, jobs=2)


@query("sc_summary", SUMM)
def _(ws):
    return summ_out(ws)


@query("dg_weather", SUMM)
def _(ws):
    return summ_out(ws)


cte("areg", """
SELECT grouping, region_adj, period, sum(temp_med * units_adj) / sum(units_adj) AS temp, sum(prec_tot * units_adj) / sum(units_adj) AS prec
FROM ts GROUP BY 1, 2, 3""")
EV = f"period BETWEEN {lit(PJ.analogue_from)} AND {lit(PJ.analogue_to)}"
cte("amon", f"""
SELECT r.grouping, r.region_adj, m.mon, coalesce(te - tc, 0) AS ta, coalesce(ln(pe / pc), 0) AS pl
FROM (SELECT DISTINCT grouping, region_adj FROM areg WHERE {EV}) r CROSS JOIN (SELECT unnest(range(1, 13)) AS mon) m
LEFT JOIN (SELECT grouping, region_adj, month(period) AS mon, avg(temp) AS tc, avg(prec) AS pc, avg(temp) FILTER ({EV}) AS te, avg(prec) FILTER ({EV}) AS pe
  FROM areg GROUP BY 1, 2, 3) x ON x.grouping = r.grouping AND x.region_adj = r.region_adj AND x.mon = m.mon""")
H = (PJ.smoothing - 1) // 2
cte("anom", f"""
SELECT a.grouping, a.region_adj, CAST(a.mon AS INTEGER) AS mon, avg(b.ta) AS temp_anom, greatest(least(exp(avg(b.pl)), 2), 0.5) AS prec_ratio
FROM amon a JOIN amon b ON a.grouping = b.grouping AND a.region_adj = b.region_adj
  AND least(abs(a.mon - b.mon), 12 - abs(a.mon - b.mon)) <= {H} GROUP BY 1, 2, 3""")
AN = f"SELECT grouping, region_adj, mon, {r('temp_anom', 6)} AS temp_anom, {r('prec_ratio', 6)} AS prec_ratio FROM anom"


@query("sc_anomaly", AN)
def _(ws):
    return out(fcs.sc_anomaly(st.ts(ws), ws.params.projection), 6)


@query("win_circular", f"""
SELECT a.grouping, a.region_adj, CAST(a.mon AS INTEGER) AS mon, {r("avg(b.ta)", 6)} AS temp_anom FROM amon a JOIN amon b
  ON a.grouping = b.grouping AND a.region_adj = b.region_adj AND least(abs(a.mon - b.mon), 12 - abs(a.mon - b.mon)) <= {H} GROUP BY 1, 2, 3""")
def _(ws):
    return out(fcs.sc_anomaly(st.ts(ws), ws.params.projection).select("grouping", "region_adj", "mon", "temp_anom"), 6)


@query("agg_anomaly_mix", f"SELECT grouping, mon, {r('avg(temp_anom)', 6)} AS temp_anom, {r('avg(prec_ratio)', 6)} AS prec_ratio FROM anom GROUP BY 1, 2")
def _(ws):
    a = fcs.sc_anomaly(st.ts(ws), ws.params.projection)
    return out(a.groupBy("grouping", "mon").agg(F.avg("temp_anom").alias("temp_anom"), F.avg("prec_ratio").alias("prec_ratio")), 6)


# -- fallback ---------------------------------------------------------------

cte("ts_obs", f"SELECT * FROM ts WHERE period <= {lit(TRAIN)} AND NOT filled AND consumption IS NOT NULL")
cte("last12", f"SELECT * FROM ts_obs QUALIFY row_number() OVER (PARTITION BY {K5} ORDER BY period DESC) <= 12")
cte("mean12", f"SELECT {K5}, avg(consumption) AS c12 FROM last12 GROUP BY {K5}")
REC = f"period > {lit(TRAIN)} - INTERVAL 12 MONTH"
cte("segm", f"SELECT grouping, region_adj, category_detail, territory, sum(vol_adj) / sum(units_adj) AS cseg FROM ts_obs WHERE {REC} GROUP BY ALL")
cte("catm", f"SELECT grouping, category_detail, territory, sum(vol_adj) / sum(units_adj) AS ccat FROM ts_obs WHERE {REC} GROUP BY ALL")
cte("tgrid", f"SELECT {K5}, period FROM ts WHERE {TESTP} AND NOT filled")
cte("fb", f"""
SELECT g.* EXCLUDE (src), o.consumption AS csn, c12, cseg, ccat, coalesce(o.consumption, c12, cseg, ccat) AS cfb
FROM (SELECT *, CAST(period - to_months(CAST(12 * ceil(datediff('month', {lit(TRAIN)}, period) / 12.0) AS INTEGER)) AS DATE) AS src FROM tgrid) g
LEFT JOIN (SELECT {K5}, period AS src, consumption FROM ts_obs) o USING ({K5}, src)
LEFT JOIN mean12 USING ({K5}) LEFT JOIN segm USING (grouping, region_adj, category_detail, territory) LEFT JOIN catm USING (grouping, category_detail, territory)""")


@query("win_last12", f"SELECT {K5}, period, {r('consumption', 4)} AS consumption FROM last12")
def _(ws):
    return out(fcs.win_last12(st.ts(ws), st.train_end(ws)).select(*GROUPED, "period", "consumption"))


@query("agg_fallback", f"SELECT grouping, region_adj, category_detail, territory, {r('cseg', 5)} AS consumption_seg, {r('ccat', 5)} AS consumption_cat FROM segm LEFT JOIN catm USING (grouping, category_detail, territory)")
def _(ws):
    _l, seg, cat = fcs.agg_fallback(st.ts(ws), st.train_end(ws))
    return out(seg.join(cat, fcs.CAT_TERR, "left"), 5)


@query("jn_lagmonth", f"SELECT {K5}, period, {r('csn', 4)} AS consumption_snaive FROM fb")
def _(ws):
    return out(fcs.fc_snaive(st.ts(ws), st.test_grid(ws), st.train_end(ws)))


@query("fc_snaive", f"SELECT {K5}, period, {r('exp(ln(csn))', 4)} AS consumption_snaive FROM fb WHERE csn IS NOT NULL")
def _(ws):
    return out(fcs.fc_snaive(st.ts(ws), st.test_grid(ws), st.train_end(ws)).where("consumption_snaive IS NOT NULL"))


@query("fc_fallback", f"""
SELECT {K5}, period, {r("csn", 4)} AS consumption_snaive, {r("c12", 4)} AS consumption_mean12, {r("cseg", 4)} AS consumption_seg,
  {r("ccat", 4)} AS consumption_cat, {r("cfb", 4)} AS consumption_fb FROM fb""")
def _(ws):
    return out(fcs.fc_fallback(st.ts(ws), st.test_grid(ws), st.train_end(ws)))


# -- units ------------------------------------------------------------------

CAND = [(i, *(round(x * fcs.UNIT) for x in g)) for i, *g in fcs.damped_grid()]


def structs(rows):
    return "[" + ", ".join("{" + ", ".join(f"'{k}': {v}" for k, v in zip("iabf", row)) + "}" for row in rows) + "]"


def damped_run(c, y="y"):
    """The squared error and the end of the recursion over the list ``y`` with the candidate ``c``; an element is a state, so that a fold has one type."""
    a, b, f = (f"({c}.{k} / {fcs.UNIT}.0::DOUBLE)" for k in "abf")
    base = f"(acc.l + {f} * acc.s)"
    start = f"{{'l': {y}[1], 's': ({y}[12] - {y}[1]) / 11.0::DOUBLE, 'q': 0.0::DOUBLE, 'v': 0.0::DOUBLE}}"
    states = f"list_transform({y}[2:], lambda v: {{'l': 0.0::DOUBLE, 's': 0.0::DOUBLE, 'q': 0.0::DOUBLE, 'v': v}})"
    step = (f"{{'l': {base} + {a} * (e.v - {base}), 's': {f} * acc.s + {b} * (e.v - {base}), 'q': acc.q + (e.v - {base}) * (e.v - {base}), 'v': 0.0::DOUBLE}}")
    end = f"list_reduce({states}, lambda acc, e: {step}, {start})"
    return f"list_transform([{end}], lambda z: {{'sse': round(z.q, 9), 'i': {c}.i, 'a': {c}.a, 'b': {c}.b, 'f': {c}.f, 'l': z.l, 's': z.s}})[1]"


def damped_sql(src_cte, keys, first, last, min_obs, tag):
    """Register the search of the damped trend over ``src_cte(keys, period, total)``."""
    bound = {n: f"least(greatest(m.{n} + d.{n} * far.{n}, {fcs.BOUNDS[n][0]}), {fcs.BOUNDS[n][1]})" for n in "abf"}
    far = f"{{'a': {[s[0] for s in fcs.STEPS]}[k + 1], 'b': {[s[1] for s in fcs.STEPS]}[k + 1], 'f': {[s[1] for s in fcs.STEPS]}[k + 1]}}"
    near = f"list_transform({structs((i, *d) for i, d in enumerate(fcs.DIRECTIONS))}, lambda d: {{'i': d.i, {', '.join(f"'{n}': {bound[n]}" for n in 'abf')}}})"
    cte(f"{tag}_y", f"""
SELECT {keys}, list(ln(total) ORDER BY period) AS y, max(period) AS fin, count(*) AS n FROM {src_cte} GROUP BY {keys} HAVING count(*) >= {min_obs}""")
    cte(f"{tag}_grid", f"SELECT {keys}, y, n, list_sort(list_transform({structs(CAND)}, lambda c: {damped_run('c')}))[1] AS m FROM {tag}_y")
    cte(f"{tag}_opt", f"""
SELECT {keys}, y, n, 1 AS it, 0 AS k, m FROM {tag}_grid
UNION ALL SELECT {keys}, y, n, it + 1, CASE WHEN x.sse < m.sse THEN k ELSE k + 1 END, CASE WHEN x.sse < m.sse THEN x ELSE m END
FROM (SELECT *, list_sort(list_transform(near, lambda c: {damped_run('c')}))[1] AS x
      FROM (SELECT *, {near} AS near FROM (SELECT *, {far} AS far FROM {tag}_opt WHERE it <= {fcs.MOVES} AND k < {len(fcs.STEPS)})))""")
    cte(f"{tag}_best", f"""
SELECT {keys}, n, m.a / {fcs.UNIT}.0::DOUBLE AS a, m.b / {fcs.UNIT}.0::DOUBLE AS b, m.f / {fcs.UNIT}.0::DOUBLE AS f, m.l AS l, m.s AS s, m.sse AS sse
FROM {tag}_opt QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY it DESC) = 1""")
    cte(f"{tag}_fc", f"""
SELECT {keys}, CAST(p AS DATE) AS period, a, b, f, exp(l + s * f * (1 - pow(f, h)) / (1 - f)) * (1 + sse / (n - 1) *
  (1 + coalesce(list_sum([pow(a + b * f * (1 - pow(f, j)) / (1 - f), 2) for j in range(1, h)]), 0)) / 2) AS forecast
FROM (SELECT k.*, p, datediff('month', (SELECT max(fin) FROM {tag}_y), p) AS h FROM {tag}_best k,
  (SELECT unnest(generate_series({lit(first)}, {lit(last)}, INTERVAL 1 MONTH)) AS p))""")


LVL = ", ".join(PJ.units_level)
cte("lvl_now", f"SELECT series_key, {LVL}, units_adj AS units_last, units_adj / sum(units_adj) OVER (PARTITION BY {LVL}) AS part FROM keys WHERE period = {lit(HIST)}")
cte("lvl_sum", f"SELECT {LVL}, period, sum(units_adj) AS total0 FROM keys SEMI JOIN lvl_now USING ({LVL}) WHERE period <= {lit(HIST)} GROUP BY {LVL}, period")
cte("lvl_full", f"""
SELECT s.*, total0, CAST(year(s.period) * 12 + month(s.period) AS DOUBLE) AS t FROM (
  SELECT {LVL}, CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS DATE) AS period FROM lvl_sum GROUP BY {LVL}) s LEFT JOIN lvl_sum USING ({LVL}, period)""")
cte("lvl", f"SELECT {LVL}, period, {interp('total0', LVL)} AS total FROM lvl_full")
damped_sql("lvl", LVL, fcs.shift_date(HIST, 1), PJ.last_period, PJ.min_obs_units, "ud")


@query("agg_units_part", f"SELECT series_key, {LVL}, {r('units_last', 4)} AS units_last, {r('part', 6)} AS part FROM lvl_now")
def _(ws):
    lvl = list(ws.params.projection.units_level)
    now = st.peaked(ws).where(F.col("period") == F.lit(st.test_end(ws))).select("series_key", *lvl, F.col("units_adj").alias("units_last"))
    return out(fcs.agg_units_part(now, lvl, "units_last"), 6, units_last=4)


@query("fc_damped", f"SELECT {LVL}, period, a AS alpha, b AS beta, f AS phi, {r('forecast', 4)} AS forecast FROM ud_fc")
def _(ws):
    p, end = ws.params.projection, st.test_end(ws)
    lvl = list(p.units_level)
    keys = st.peaked(ws)
    now = keys.where(F.col("period") == F.lit(end)).select(*lvl).distinct()
    past = keys.where(F.col("period") <= F.lit(end)).join(now, lvl, "left_semi")
    tot = fcs.level_totals(past, lvl, "units_adj")
    return out(fcs.fc_damped(tot, lvl, "total", fcs.shift_date(end, 1), p.last_period, p.min_obs_units))


cte("ukey", f"""
SELECT n.series_key, CAST(p AS DATE) AS period, coalesce(forecast * part, units_last) AS units, forecast IS NOT NULL AS ok
FROM lvl_now n CROSS JOIN (SELECT unnest(generate_series({lit(fcs.shift_date(HIST, 1))}, {lit(PJ.last_period)}, INTERVAL 1 MONTH)) AS p)
LEFT JOIN ud_fc f ON {" AND ".join(f"f.{c} = n.{c}" for c in PJ.units_level)} AND f.period = p""")


def units_key(ws):
    return ws.stage("units_key", lambda: fcs.fc_units_key(st.peaked(ws), st.test_end(ws), ws.params.projection.last_period, ws.params.projection))


@query("fc_units_key", f"""
SELECT series_key, period, {r("units", 4)} AS units, {r("units", 4)} AS units_trend, CASE WHEN ok THEN 'ets_amortecido' ELSE 'ultimo_valor' END AS method FROM ukey""")
def _(ws):
    p = ws.params.projection
    return out(fcs.fc_units_key(st.peaked(ws), st.test_end(ws), p.last_period, p))


# -- tariff -----------------------------------------------------------------

cte("tpath", f"""
WITH t AS (SELECT category_detail, period, max(real_tariff) AS tariff FROM mbase GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY category_detail ORDER BY period DESC) AS rn FROM t WHERE period <= {lit(HIST)}),
z AS (SELECT category_detail, max(tariff) FILTER (rn = 1) AS last, avg(tariff) AS ref FROM k WHERE rn <= 12 GROUP BY 1)
SELECT category_detail, CAST(p AS DATE) AS period, row_number() OVER (PARTITION BY category_detail ORDER BY p) AS k, ref AS tariff_ref,
  last / pow(pow({1 + PJ.inflation}::DOUBLE, 1.0::DOUBLE / 12), row_number() OVER (PARTITION BY category_detail ORDER BY p)) * CASE WHEN p >= {lit(PJ.adjustment_month)} THEN {1 + PJ.adjustment} ELSE 1 END AS tariff
FROM z CROSS JOIN (SELECT unnest(generate_series({lit(fcs.shift_date(HIST, 1))}, {lit(PJ.last_period)}, INTERVAL 1 MONTH)) AS p)""")
cte("tfactor", f"""
SELECT category_detail, period, pow(tariff / tariff_ref, eps) AS factor, pow(tariff / tariff_ref, eps * {PJ.sensitivity_low}) AS factor_low,
  pow(tariff / tariff_ref, eps * {PJ.sensitivity_high}) AS factor_high FROM (SELECT *, CAST({PJ.default_elasticity} AS DOUBLE) AS eps FROM tpath)""")


def tariff_path(ws):
    return ws.stage("tariff_path", lambda: fcs.fc_tariff_path(series.ts_tariff(st.mbase(ws)), st.test_end(ws), ws.params.projection))


@query("win_horizon", "SELECT category_detail, period, CAST(k AS INTEGER) AS k FROM tpath")
def _(ws):
    p = ws.params.projection
    cats = st.mbase(ws).select("category_detail").distinct()
    return fcs.win_horizon(cats, fcs.shift_date(st.test_end(ws), 1), p.last_period)


@query("fc_tariff_path", f"SELECT category_detail, period, {r('tariff', 6)} AS tariff, {r('tariff_ref', 6)} AS tariff_ref FROM tpath")
def _(ws):
    return out(tariff_path(ws), 6)


@query("fc_tariff_factor", f"SELECT category_detail, period, {r('factor', 6)} AS factor, {r('factor_low', 6)} AS factor_low, {r('factor_high', 6)} AS factor_high FROM tfactor")
def _(ws):
    return out(fcs.fc_tariff_factor(tariff_path(ws), ws.spark, ws.params.projection), 6)

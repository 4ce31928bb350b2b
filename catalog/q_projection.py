"""Queries: new connections, projected units and volumes, monthly and annual results."""

from pyspark.sql import functions as F

from metermill.functions.text import normalise_name
from metermill.operators import forecast as fcs
from metermill.operators import projection as pj
from metermill.operators import series
from metermill.operators.series import GROUPED

from . import stages as st
from .q_eval import choices
from .q_model import HIST, K5, OFF, tariff_path, units_key
from .q_sources import premise_stage
from .registry import out, query
from .sqlkit import P, big, cte, d, inlist, lit, r, values

PJ, BT = P.projection, P.backtest
SCENS = ("base", "el_nino")
BUMP = {"base": 1.0, "el_nino": 1.01}
FUT = f"(SELECT CAST(unnest(generate_series({lit(fcs.shift_date(HIST, 1))}, {lit(PJ.last_period)}, INTERVAL 1 MONTH)) AS DATE) AS period)"
RES_DETAILS = ("Residencial Normal", "Residencial Social", "Residencial Social Vulnerável")


@query("prj_normname", """
SELECT municipality, replace(upper(municipality), '_', ' ') AS name_norm, count(*) AS n FROM stage1 GROUP BY 1""")
def _(ws):
    g = st.stage1(ws).groupBy("municipality").agg(F.count("*").alias("n"))
    return g.withColumn("name_norm", normalise_name("municipality"))


@query("prj_usage_map", """
SELECT usage_norm, m.category_detail, m.territory, count(*) AS n FROM usage_map m JOIN keys k USING (category_detail, territory) GROUP BY ALL""")
def _(ws):
    n = st.peaked(ws).groupBy("category_detail", "territory").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(pj.prj_usage_map(ws.spark)), ["category_detail", "territory"])


from metermill import rules  # noqa: E402

cte("usage_map", "SELECT upper(u) AS usage_norm, category_detail, territory FROM " + values("t", "u, category_detail, territory", rules.USAGE_MAP))
cte("inc", """
SELECT municipality_norm, usage_norm, period, sum(increment) AS increment FROM premise WHERE type_norm IN ('AGUA', 'A E', 'AE') GROUP BY 1, 2, 3""")
cte("stock_now", f"""
SELECT series_key, replace(upper(municipality), '_', ' ') AS municipality_norm, category_detail, territory, units FROM keys
WHERE period = {lit(HIST)} AND category_detail IN {inlist(RES_DETAILS)}""")
cte("own_dest", """
SELECT p.municipality_norm, p.usage_norm, series_key, units, 'de_para' AS rule FROM (SELECT DISTINCT municipality_norm, usage_norm FROM inc) p
JOIN usage_map USING (usage_norm) JOIN stock_now USING (municipality_norm, category_detail, territory)""")
cte("dest", """
SELECT *, units / sum(units) OVER (PARTITION BY municipality_norm, usage_norm) AS weight FROM (
  SELECT * FROM own_dest UNION ALL SELECT p.municipality_norm, p.usage_norm, s.series_key, s.units, 'municipio' FROM (SELECT DISTINCT municipality_norm, usage_norm FROM inc) p
  ANTI JOIN own_dest o ON o.municipality_norm = p.municipality_norm AND o.usage_norm = p.usage_norm JOIN stock_now s ON s.municipality_norm = p.municipality_norm)""")
cte("alloc", "SELECT series_key, i.period, rule, sum(increment * weight) AS increment FROM inc i JOIN dest USING (municipality_norm, usage_norm) GROUP BY 1, 2, 3")


def res_keys(ws):
    return st.peaked(ws).where(F.col("category_detail").isin(*RES_DETAILS))


def increments(ws):
    return pj.premise_increments(premise_stage(ws.whole), ws.params.backtest.target)


def targets(ws):
    return pj.premise_targets(increments(ws), res_keys(ws), pj.prj_usage_map(ws.spark), st.test_end(ws))


def alloc(ws):
    return ws.stage("alloc", lambda: pj.agg_alloc(increments(ws), targets(ws)))


@query("jn_anti_pairs", """
SELECT p.municipality_norm, p.usage_norm FROM (SELECT DISTINCT municipality_norm, usage_norm FROM inc) p
ANTI JOIN own_dest o ON o.municipality_norm = p.municipality_norm AND o.usage_norm = p.usage_norm""")
def _(ws):
    own = targets(ws).where("rule = 'de_para'")
    return pj.jn_anti_pairs(increments(ws).select(*pj.PAIR).distinct(), own)


@query("agg_alloc", f"SELECT series_key, period, rule, {r('increment', 5)} AS increment FROM alloc")
def _(ws):
    return out(pj.agg_alloc(increments(ws), targets(ws)), 5)


@query("fc_alloc", f"""
SELECT rule, {r("sum(increment)", 4)} AS increment FROM alloc GROUP BY 1
UNION ALL SELECT 'nao_alocado', {r("(SELECT sum(increment) FROM inc) - (SELECT sum(increment) FROM alloc)", 4)}""")
def _(ws):
    return out(pj.alloc_report(increments(ws), pj.agg_alloc(increments(ws), targets(ws))))


@query("agg_premise_mix", f"SELECT usage, type, count(DISTINCT municipality) AS municipalities, {r('sum(increment)', 3)} AS increment FROM premise GROUP BY 1, 2")
def _(ws):
    return out(pj.agg_premise_mix(premise_stage(ws)), 3)


@query("agg_premise_allocated", f"""
SELECT region_adj, category_detail, territory, a.period, rule, {r("sum(increment)", 4)} AS increment FROM alloc a
JOIN (SELECT DISTINCT series_key, region_adj, category_detail, territory FROM keys) k USING (series_key) GROUP BY ALL""")
def _(ws):
    return out(pj.premise_allocated(alloc(ws), st.peaked(ws)))


cte("cum_inc", """
SELECT u.series_key, u.period, u.units, u.ok, coalesce(x.i, 0) AS inc, sum(coalesce(x.i, 0)) OVER (PARTITION BY u.series_key ORDER BY u.period) AS inc_cum
FROM ukey u LEFT JOIN (SELECT series_key, period, sum(increment) AS i FROM alloc GROUP BY 1, 2) x USING (series_key, period)""")


@query("win_cum_inc", f"SELECT series_key, period, {r('inc', 4)} AS inc, {r('inc_cum', 4)} AS inc_cum FROM cum_inc")
def _(ws):
    return out(pj.win_cum_inc(units_key(ws), alloc(ws)).select("series_key", "period", "inc", "inc_cum"))


cte("upremise", """
SELECT c.series_key, c.period, c.units AS units_trend,
  CASE WHEN c.period >= p0 AND cov THEN ref + inc_cum ELSE c.units END AS units,
  CASE WHEN c.period >= p0 AND cov THEN 'premissa_engenharia' WHEN ok THEN 'ets_amortecido' ELSE 'ultimo_valor' END AS method
FROM cum_inc c CROSS JOIN (SELECT min(period) AS p0 FROM alloc)
JOIN (SELECT DISTINCT series_key, replace(upper(municipality), '_', ' ') IN (SELECT municipality_norm FROM premise WHERE type_norm IN ('AGUA', 'A E', 'AE'))
  AND category_detail IN """ + inlist(RES_DETAILS) + """ AS cov FROM keys) USING (series_key)
LEFT JOIN (SELECT series_key, units AS ref FROM ukey WHERE period = (SELECT min(period) - INTERVAL 1 MONTH FROM alloc)) USING (series_key)""")


def units_premise(ws):
    p = ws.params.projection
    cities = pj.covered_cities(premise_stage(ws.whole), ws.params.backtest.target, p.coverage)
    # only the premise's segment is covered; other series keep the trend
    res = res_keys(ws)
    mine = res.select("series_key").distinct()
    u = units_key(ws)
    done = pj.fc_premise(u.join(mine, "series_key", "left_semi"), alloc(ws), res, cities, st.test_end(ws), p.outside_premise)
    return done.unionByName(u.join(mine, "series_key", "left_anti").select(*done.columns))


def units_premise_stage(ws):
    return ws.stage("units_premise", lambda: units_premise(ws))


@query("fc_premise", f"SELECT series_key, period, {r('units', 4)} AS units, {r('units_trend', 4)} AS units_trend, method FROM upremise")
def _(ws):
    return out(units_premise(ws))


GRPS = f"""(SELECT series_key, 'G1_municipioA_clusterBC' AS grouping, region_adj, CASE WHEN {OFF} THEN municipality || '_' || office WHEN abc_class = 'A' THEN municipality
  ELSE 'cluster_' || region END AS "group", category_detail, territory FROM keys WHERE period = {lit(HIST)}
UNION ALL SELECT series_key, 'G2_superintendencia', region_adj, region_adj, category_detail, territory FROM keys WHERE period = {lit(HIST)})"""
cte("ugroup", f"""
SELECT {K5}, period, arg_min(method, (-c, method)) AS method, sum(u) AS units, sum(ut) AS units_trend FROM (
  SELECT {K5}, period, method, count(*) AS c, sum(units) AS u, sum(units_trend) AS ut FROM upremise JOIN {GRPS} USING (series_key) GROUP BY {K5}, period, method)
GROUP BY {K5}, period""")


def units_group(ws):
    return pj.agg_units_group(units_premise_stage(ws), st.peaked(ws), ws.params.backtest.groupings, ws.params.grouping, st.test_end(ws))


@query("agg_units_group", f"SELECT {K5}, period, method, {r('units', 4)} AS units, {r('units_trend', 4)} AS units_trend FROM ugroup")
def _(ws):
    return out(units_group(ws))


# -- volume -----------------------------------------------------------------

cte("pinfo", f"""
SELECT *, coalesce(last_hist = {lit(HIST)}, FALSE) AS active, coalesce(last_hist = {lit(HIST)}, FALSE) AND n_hist >= {PJ.min_obs_model} AS eligible FROM (
  SELECT {K5}, count(*) FILTER (consumption IS NOT NULL) AS n_hist, max(period) AS last_hist FROM ts WHERE period <= {lit(HIST)} GROUP BY {K5})""")
cte("pchoice", f"""
SELECT c.category_detail, coalesce(a.grouping, {lit(PJ.default_choice[0])}) AS grouping, coalesce(a.model, {lit(PJ.default_choice[1])}) AS model
FROM (SELECT DISTINCT category_detail FROM mbase) c LEFT JOIN (SELECT * FROM decision WHERE category_detail <> 'Industrial') a USING (category_detail)""")
cte("pseries", f"SELECT {K5}, model FROM pinfo JOIN pchoice USING (category_detail, grouping) WHERE active")
cte("pobs", f"SELECT * FROM ts WHERE period <= {lit(HIST)} AND NOT filled AND consumption IS NOT NULL")
PREC = f"period > {lit(HIST)} - INTERVAL 12 MONTH"
cte("pfb", f"""
SELECT g.{K5.replace(', ', ', g.')}, g.model, g.period, o.consumption AS csn, coalesce(o.consumption, c12, cseg, ccat) AS cfb
FROM (SELECT s.*, f.period, CAST(f.period - to_months(CAST(12 * ceil(datediff('month', {lit(HIST)}, f.period) / 12.0) AS INTEGER)) AS DATE) AS src FROM pseries s CROSS JOIN {FUT} f) g
LEFT JOIN (SELECT {K5}, period AS src, consumption FROM pobs) o USING ({K5}, src)
LEFT JOIN (SELECT {K5}, avg(consumption) AS c12 FROM (SELECT * FROM pobs QUALIFY row_number() OVER (PARTITION BY {K5} ORDER BY period DESC) <= 12) GROUP BY {K5}) m USING ({K5})
LEFT JOIN (SELECT grouping, region_adj, category_detail, territory, sum(vol_adj) / sum(units_adj) AS cseg FROM pobs WHERE {PREC} GROUP BY ALL) sg USING (grouping, region_adj, category_detail, territory)
LEFT JOIN (SELECT grouping, category_detail, territory, sum(vol_adj) / sum(units_adj) AS ccat FROM pobs WHERE {PREC} GROUP BY ALL) ct USING (grouping, category_detail, territory)""")
cte("proj", f"""
SELECT *, consumption_model * factor AS consumption, consumption_model * factor * units AS vol, consumption_model * factor_low * units AS vol_eps_low,
  consumption_model * factor_high * units AS vol_eps_high, consumption_model * factor * units_trend AS vol_units_trend FROM (
  SELECT {K5}, model, f.period, 'PROJ' AS kind, scenario, units, units_trend, method, factor, factor_low, factor_high,
    CASE WHEN NOT eligible OR csn IS NULL THEN cfb ELSE csn * bump END AS consumption_model,
    CASE WHEN NOT eligible THEN 'nao_elegivel' WHEN csn IS NULL THEN 'falha_modelo' ELSE 'modelo' END AS fallback
  FROM pfb f CROSS JOIN {values("b", "scenario, bump", [(k, v) for k, v in BUMP.items()])}
  JOIN pinfo USING ({K5}) LEFT JOIN ugroup USING ({K5}, period) LEFT JOIN tfactor USING (category_detail, period))""")


def pinfo(ws):
    return series.agg_series_info(st.ts(ws), st.test_end(ws), ws.params.projection.min_obs_model)


def plain_choice(ws):
    """Choices of the workspace's own target: a part of the run reads those of all parts, the merged segment has its own."""
    b = ws.params.backtest
    if ws.whole is ws:
        return choices(ws).where(F.col("target") == b.target)
    from .q_parts import part_choices

    return part_choices(ws.whole).where((F.col("segment") == b.segment) & (F.col("target") == b.target))


def proj(ws):
    """Projection with the seasonal naive standing for the chosen model."""

    def make():
        p, end = ws.params.projection, st.test_end(ws)
        info = pinfo(ws)
        chosen = pj.chosen_series(info, plain_choice(ws))
        grid = pj.project_grid(chosen, end, p.last_period, SCENS)
        fb = fcs.fc_fallback(st.ts(ws), grid.select(*GROUPED, "period").distinct(), end)
        bump = F.when(F.col("scenario") == "el_nino", BUMP["el_nino"]).otherwise(1.0)
        fc = grid.join(fb.select(*GROUPED, "period", "consumption_snaive"), [*GROUPED, "period"]).select(
            *GROUPED, "model", "period", "scenario", (F.col("consumption_snaive") * bump).alias("forecast")
        )
        factors = fcs.fc_tariff_factor(tariff_path(ws), ws.spark, p)
        return pj.fc_volume(grid, fc, fb, info, units_group(ws), factors)

    return ws.stage("proj_plain", make)


PD = ["units", "units_trend", "consumption_model", "consumption", "vol", "vol_eps_low", "vol_eps_high", "vol_units_trend"]


@query("fc_volume", f"SELECT {K5}, model, period, kind, scenario, fallback, method, {r('factor', 6)} AS tariff_factor, {', '.join(r(c, 4) + f' AS {c}' for c in PD)} FROM proj")
def _(ws):
    return out(proj(ws), tariff_factor=6)


def real(ws):
    chosen = pj.chosen_series(pinfo(ws).withColumn("active", F.lit(True)), plain_choice(ws))
    rows = st.ts(ws).join(chosen.select(*GROUPED), GROUPED, "left_semi")
    return series.ts_impute_hist(rows, st.test_end(ws), ws.params.projection.max_imputed_run)


def monthly(ws):
    """Monthly result of the workspace's segment and target."""
    b = ws.params.backtest
    return ws.stage("monthly_plain", lambda: pj.agg_mensal(proj(ws), real(ws), SCENS, b.segment, b.target))


cte("month_result", f"""
SELECT {lit(BT.segment)} AS segment, 'med_agua' AS target, scenario, region_adj, category_detail, territory, period, kind,
  {", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in pj.MEASURES)} FROM (
  SELECT scenario, region_adj, category_detail, territory, period, kind, {", ".join(pj.MEASURES)} FROM proj
  UNION ALL SELECT scenario, region_adj, category_detail, territory, period, kind, units, units AS units_trend, vol, vol AS a, vol AS b, vol AS c
  FROM real_hist SEMI JOIN pchoice USING (category_detail, grouping) CROSS JOIN (SELECT unnest({list(SCENS)}) AS scenario)) GROUP BY ALL""")
MD = ", ".join(r(c, 4) + f" AS {c}" for c in pj.MEASURES)


def _annual(level, dims):
    dd = "".join(f"{c}, " for c in dims)
    cols = ", ".join(c if c in dims else f"CAST(NULL AS VARCHAR) AS {c}" for c in ("region_adj", "category_detail"))
    return f"""SELECT segment, target, scenario, '{level}' AS level, {cols}, CAST(year(period) AS INTEGER) AS "year", sum(vol) AS vol, sum(vol_eps_low) AS vol_eps_low,
    sum(vol_eps_high) AS vol_eps_high, sum(vol_units_trend) AS vol_units_trend, avg(units) AS units_mean, avg(units_trend) AS units_trend_mean,
    CAST(sum(is_proj) AS BIGINT) AS projected_months, sum(vol) / nullif(avg(units), 0) / 12 AS consumption_mean
  FROM (SELECT segment, target, scenario, {dd} period, {", ".join(f"sum({c}) AS {c}" for c in pj.MEASURES)}, max(CASE WHEN kind = 'PROJ' THEN 1 ELSE 0 END) AS is_proj
    FROM month_result GROUP BY ALL) GROUP BY ALL"""


cte("annual0", " UNION ALL ".join(_annual(k, v) for k, v in (("total", ()), ("categoria", ("category_detail",)), ("superintendencia", ("region_adj",)))))
YW = 'OVER (PARTITION BY segment, target, scenario, level, region_adj, category_detail ORDER BY "year")'
AD = ["vol", "vol_eps_low", "vol_eps_high", "vol_units_trend", "units_mean", "units_trend_mean", "consumption_mean"]
ANNUAL_COLUMNS = f"""SELECT segment, target, scenario, level, region_adj, category_detail, "year", projected_months, {", ".join(r(c, 4) + f" AS {c}" for c in AD)},
  {r(f"vol / nullif(lag(vol) {YW}, 0) - 1", 6)} AS var_vol, {r(f"units_mean / nullif(lag(units_mean) {YW}, 0) - 1", 6)} AS var_units,
  {r(f"consumption_mean / nullif(lag(consumption_mean) {YW}, 0) - 1", 6)} AS var_consumption FROM"""


@query("win_yoy", f"""
SELECT category_detail, "year", {r("v", 4)} AS vol, {r('v / nullif(lag(v) OVER (PARTITION BY category_detail ORDER BY "year"), 0) - 1', 6)} AS var_vol
FROM (SELECT category_detail, CAST(year(period) AS INTEGER) AS "year", sum(vol_meas_water) AS v FROM mbase GROUP BY 1, 2)""")
def _(ws):
    g = st.mbase(ws).groupBy("category_detail", F.year("period").alias("year")).agg(F.sum("vol_meas_water").alias("vol"))
    return out(pj.win_yoy(g, ["category_detail"], {"vol": "var_vol"}), 6, vol=4)


@query("sc_apply", f"""
SELECT {K5}, period, 'el_nino' AS scenario, {r(f"temp_med + CASE WHEN {{on}} THEN {PJ.intensity} * coalesce(temp_anom, 0) ELSE 0 END".replace("{on}", f"period BETWEEN {lit(P.backtest.cut)} AND DATE '2001-04-01'"), 4)} AS temp_med,
  {r(f"prec_tot * CASE WHEN {{on}} THEN pow(coalesce(prec_ratio, 1), {PJ.intensity}) ELSE 1 END".replace("{on}", f"period BETWEEN {lit(P.backtest.cut)} AND DATE '2001-04-01'"), 4)} AS prec_tot, {r("jobs", 2)} AS jobs
FROM (SELECT *, month(period) AS mon FROM scen WHERE scenario = 'base') LEFT JOIN anom USING (grouping, region_adj, mon)""")
def _(ws):
    from dataclasses import replace
    from datetime import date

    p = replace(ws.params.projection, apply_from=ws.params.backtest.cut, apply_to=date(2001, 4, 1))
    base = st.scenarios(ws).where("scenario = 'base'")
    return out(fcs.sc_apply(base, fcs.sc_anomaly(st.ts(ws), p), p, "el_nino"), jobs=2)

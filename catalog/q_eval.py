"""Queries: accuracy, selection, elasticity summaries.

The oracle-checked ones run on forecasts SQL can repeat: seasonal naive, mean
of the last year and the segment ratio stand as models of the backtest."""

from pyspark.sql import functions as F

from metermill import rules
from metermill.operators import evaluate as ev
from metermill.operators import forecast as fcs
from metermill.operators.series import GROUPED

from . import stages as st
from .q_model import CUT, K5, TEST_END, TRAIN
from .registry import out, query
from .sqlkit import P, big, cte, inlist, lit, r, values

BT = P.backtest
PLAIN = ("snaive", "arima_0", "arima_2_sem_drift")
SCENS = ("realizado", "base", "quente_seco")
BUMP = {"realizado": 1.0, "base": 1.0, "quente_seco": 1.02}


def plain_forecasts(ws):
    """The fallback's parts as forecasts of three models, hotter = 2 % more."""
    fb = fcs.fc_fallback(st.ts(ws), st.test_grid(ws), st.train_end(ws))
    cells = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(s).alias("scenario"), (F.col(c) * F.lit(BUMP[s])).alias("forecast"))
        for m, c in zip(PLAIN, ("consumption_snaive", "consumption_mean12", "consumption_seg")) for s in SCENS
    ]))
    return fb, fb.select(*GROUPED, "period", cells.alias("c")).select(*GROUPED, "period", "c.*")


def plain_cells(ws):
    def make():
        fb, fc = plain_forecasts(ws)
        return ev.jn_assemble(st.test_rows(ws), fc, fb, st.info(ws), None, PLAIN, SCENS, ws.params.backtest.actual)

    return ws.stage("plain_cells", make)


BUMPS = values("b", "scenario, bump", [(k, v) for k, v in BUMP.items()])
cte("cells", f"""
SELECT x.grouping, scenario, model, x.region_adj, x."group", x.category_detail, x.territory, x.period, units_raw AS units, vol_raw AS vol_actual,
  CASE WHEN NOT eligible OR fc IS NULL THEN cfb ELSE fc * bump END * units_raw AS vol_fit,
  CASE WHEN NOT eligible THEN 'nao_elegivel' WHEN fc IS NULL THEN 'falha_modelo' ELSE 'modelo' END AS fallback
FROM (SELECT {K5}, period, cfb, 'snaive' AS model, csn AS fc FROM fb UNION ALL SELECT {K5}, period, cfb, 'arima_0', c12 FROM fb
  UNION ALL SELECT {K5}, period, cfb, 'arima_2_sem_drift', cseg FROM fb) x
JOIN ts USING ({K5}, period) JOIN info USING ({K5}) CROSS JOIN {BUMPS}""")
MERGED = BT.merged_months[0]
cte("judged", f"SELECT * REPLACE (CASE WHEN period IN {'(' + ', '.join(lit(x) for x in MERGED) + ')'} THEN {lit(min(MERGED))} ELSE period END AS period) FROM cells")
CELLD = ["units", "vol_actual", "vol_fit"]
CELL_SQL = f"SELECT grouping, scenario, model, region_adj, \"group\", category_detail, territory, period, {', '.join(r(c, 4) + f' AS {c}' for c in CELLD)}, fallback FROM "


@query("jn_grid", f"""
SELECT grouping, model, scenario, count(*) AS n FROM (SELECT {K5}, period FROM tgrid), (SELECT unnest({list(PLAIN)}) AS model), (SELECT unnest({list(SCENS)}) AS scenario) GROUP BY 1, 2, 3""")
def _(ws):
    return ev.jn_grid(st.test_grid(ws), PLAIN, SCENS).groupBy("grouping", "model", "scenario").agg(F.count("*").alias("n"))


@query("jn_assemble", CELL_SQL + "cells")
def _(ws):
    fb, fc = plain_forecasts(ws)
    return out(ev.jn_assemble(st.test_rows(ws), fc, fb, st.info(ws), None, PLAIN, SCENS, ws.params.backtest.actual))


def judged(ws):
    return ev.prj_month_merge(plain_cells(ws), ws.params.backtest.merged_months)


@query("prj_month_merge", CELL_SQL + "judged")
def _(ws):
    return out(judged(ws))


def metric_sql():
    e = "(vol_fit - vol_actual)"
    return {
        "mape": f"100 * avg(abs{e} / vol_actual)", "wape": f"100 * sum(abs{e}) / nullif(sum(vol_actual), 0)",
        "smape": f"100 * avg(2 * abs{e} / nullif(abs(vol_actual) + abs(vol_fit), 0))", "ape_max": f"100 * max(abs{e} / vol_actual)",
        "bias": f"100 * sum{e} / nullif(sum(vol_actual), 0)", "mae": f"avg(abs{e})", "rmse": f"sqrt(avg({e} * {e}))",
        "rmse_consumption": f"sqrt(avg(pow({e} / nullif(units, 0), 2)))",
    }


MET = ", ".join(f"{r(r(e, 8), 5)} AS {k}" for k, e in metric_sql().items()) + ", count(*) AS n"
METRAW = ", ".join(f"{r(e, 8)} AS {k}" for k, e in metric_sql().items()) + ", count(*) AS n"


def lvl_sql(dims, extra=""):
    d_ = "".join(f", {x}" for x in dims)
    return f"(SELECT grouping, scenario, model{d_}, period, coalesce(sum(units), 0) AS units, coalesce(sum(vol_actual), 0) AS vol_actual, coalesce(sum(vol_fit), 0) AS vol_fit FROM judged {extra} GROUP BY ALL HAVING sum(vol_actual) > 0)"


@query("acc_metrics", f"SELECT grouping, scenario, model, {MET} FROM judged WHERE vol_actual > 0 GROUP BY 1, 2, 3")
def _(ws):
    return out(ev.acc_metrics(judged(ws), ev.CELL), 5)


CELL_COLS = ["grouping", "scenario", "model", "region_adj", "category_detail", "territory", "period", "units", "vol_actual", "vol_fit"]
# the external forecast is judged beside the models where it has a value; it never takes part in the selection
cte("judged_ext", f"""SELECT {", ".join(CELL_COLS)} FROM judged
UNION ALL SELECT 'LCA', scenario, 'LCA', region_adj, category_detail, territory, period, units, vol_actual, vol_fit FROM ext_cells WHERE covered""")


@query("acc_levels", " UNION ALL ".join(
    f"SELECT '{lv}' AS level, grouping, scenario, model, {MET} FROM {lvl_sql(dims).replace('FROM judged', 'FROM judged_ext')} GROUP BY grouping, scenario, model"
    for lv, dims in rules.ACCURACY_LEVELS.items()))
def _(ws):
    ext = ext_cells(ws).where("covered").select(*CELL_COLS)
    return out(ev.acc_levels(judged(ws).select(*CELL_COLS).unionByName(ext)), 5)


BY = list(BT.select_by)
SEL_DIMS = list(dict.fromkeys([*rules.ACCURACY_LEVELS[BT.select_level], *BY]))


def acc_sel(ws):
    b = ws.params.backtest
    a = ev.acc_at(judged(ws), rules.ACCURACY_LEVELS[b.select_level], by=list(b.select_by))
    return a.where(F.col("scenario") == b.select_scenario)


cte("acc_sel", f"SELECT grouping, scenario, model, {', '.join(BY)}, {METRAW} FROM {lvl_sql(SEL_DIMS)} WHERE scenario = '{BT.select_scenario}' GROUP BY ALL")
cte("acc_ranked", f"SELECT *, row_number() OVER (PARTITION BY category_detail ORDER BY {BT.metric}, grouping, model) AS rank FROM acc_sel")
cte("n_ser", "SELECT grouping, count(*) AS n_series FROM info GROUP BY 1")


def ranked(ws):
    b = ws.params.backtest
    return ev.win_rank(acc_sel(ws), list(b.select_by), b.metric)


def n_series(ws):
    return st.info(ws).groupBy("grouping").agg(F.count("*").alias("n_series"))


def rank_out(df):
    return out(df.select("category_detail", "grouping", "model", "rank", "wape", "bias"), 5)


RANK_SQL = f"SELECT category_detail, grouping, model, CAST(rank AS INTEGER) AS rank, {r('wape', 5)} AS wape, {r('bias', 5)} AS bias FROM acc_ranked"


@query("win_rank", RANK_SQL)
def _(ws):
    return rank_out(ranked(ws))


@query("top_rank3", RANK_SQL + " WHERE rank <= 3")
def _(ws):
    return rank_out(ev.top_rank3(ranked(ws)))


@query("top_argmin", f"SELECT category_detail, grouping, model, {r('wape', 5)} AS wape FROM acc_ranked WHERE rank = 1")
def _(ws):
    return out(ev.top_argmin(acc_sel(ws), ["category_detail"], "wape"), 5)


@query("sel_models", f"""
SELECT category_detail, model, best_grouping, {r("mb", 5)} AS metric_best, {r("mm", 5)} AS metric_mean, model = 'snaive' AS benchmark,
  CAST(row_number() OVER (PARTITION BY category_detail ORDER BY mb, model) AS INTEGER) AS rank
FROM (SELECT category_detail, model, arg_min(grouping, (wape, grouping)) AS best_grouping, min(wape) AS mb, avg(wape) AS mm FROM acc_sel GROUP BY 1, 2)""")
def _(ws):
    return out(ev.sel_models(acc_sel(ws), BY, "wape"), 5)


@query("sel_group", f"""
SELECT grouping, category_detail, best_model, {r("mb", 5)} AS metric_best, {r("md", 5)} AS metric_median, n_series,
  CAST(row_number() OVER (PARTITION BY category_detail ORDER BY mb, grouping) AS INTEGER) AS rank
FROM (SELECT category_detail, grouping, arg_min(model, (wape, model)) AS best_model, min(wape) AS mb, quantile_cont(wape, 0.5) AS md
  FROM acc_sel WHERE model <> 'snaive' GROUP BY 1, 2) LEFT JOIN n_ser USING (grouping)""")
def _(ws):
    return out(ev.sel_group(acc_sel(ws), n_series(ws), BY, "wape"), 5)


cte("pick", f"""
SELECT category_detail, grouping, model, wape, n_series FROM (
  SELECT a.*, n_series, min(wape) OVER (PARTITION BY category_detail) AS best FROM acc_sel a LEFT JOIN n_ser USING (grouping) WHERE model <> 'snaive')
WHERE wape <= best + {BT.tolerance}
QUALIFY row_number() OVER (PARTITION BY category_detail ORDER BY CASE WHEN model LIKE '%sem_drift%' THEN 0 ELSE 1 END, n_series, wape, grouping, model) = 1""")
PICK = f"SELECT category_detail, grouping, model, {r('wape', 5)} AS wape, n_series FROM pick"


@query("win_tol_pick", PICK)
def _(ws):
    b = ws.params.backtest
    return out(ev.win_tol_pick(ranked(ws), n_series(ws), BY, b.metric, b.tolerance).select("category_detail", "grouping", "model", "wape", "n_series"), 5)


@query("top_first", PICK)
def _(ws):
    b = ws.params.backtest
    return out(ev.win_tol_pick(ranked(ws), n_series(ws), BY, b.metric, b.tolerance).select("category_detail", "grouping", "model", "wape", "n_series"), 5)


def choice(ws):
    b = ws.params.backtest
    return ws.stage("plain_choice", lambda: ev.sel_choice(ranked(ws), n_series(ws), BY, b.metric, b.tolerance))


cte("choice", "SELECT a.*, p.model IS NOT NULL AS chosen FROM acc_ranked a LEFT JOIN (SELECT category_detail, grouping, model FROM pick) p USING (category_detail, grouping, model)")


@query("sel_choice", f"SELECT category_detail, grouping, model, CAST(rank AS INTEGER) AS rank, {r('wape', 5)} AS wape, EXISTS (SELECT 1 FROM pick p WHERE p.category_detail = a.category_detail AND p.grouping = a.grouping AND p.model = a.model) AS chosen FROM acc_ranked a")
def _(ws):
    b = ws.params.backtest
    c = ev.sel_choice(ranked(ws), n_series(ws), BY, b.metric, b.tolerance)
    return out(c.select("category_detail", "grouping", "model", "rank", "wape", "chosen"), 5)


cte("combined", "SELECT j.* REPLACE ('COMBINADO' AS grouping, 'escolha' AS model) FROM judged j SEMI JOIN pick USING (category_detail, grouping, model)")


@query("sel_combined", CELL_SQL + "combined")
def _(ws):
    return out(ev.sel_combined(judged(ws), choice(ws), BY))


def decision(ws):
    def make():
        comb = ev.acc_at(ev.sel_combined(judged(ws), choice(ws), BY), ()).where(F.col("scenario") == BT.select_scenario)
        return ev.sel_decision(choice(ws), comb, ws.params.backtest, ws.params.backtest.target)

    return ws.stage("decision", make)


cte("decision", f"""
WITH c AS (SELECT period, sum(units) AS units, sum(vol_actual) AS vol_actual, sum(vol_fit) AS vol_fit FROM combined WHERE scenario = '{BT.select_scenario}' GROUP BY 1 HAVING sum(vol_actual) > 0),
t AS (SELECT {METRAW} FROM c)
SELECT {lit(BT.segment)} AS segment, 'med_agua' AS target, p.category_detail, p.grouping, p.model, 'consumo/economia' AS model_kind, {lit(BT.select_level)} AS level,
  {lit(BT.select_scenario)} AS scenario, {lit(BT.metric)} AS metric, p.wape AS value, best_value, benchmark_value, CAST({BT.tolerance} AS DOUBLE) AS tolerance,
  t.mape AS mape_combined, t.wape AS wape_combined, t.bias AS bias_combined
FROM pick p JOIN (SELECT category_detail, min(wape) FILTER (model <> 'snaive') AS best_value, min(wape) FILTER (model = 'snaive') AS benchmark_value FROM acc_sel GROUP BY 1)
USING (category_detail), t""")
DEC = ["value", "best_value", "benchmark_value", "tolerance", "mape_combined", "wape_combined", "bias_combined"]


def choices(ws):
    from metermill.sources import landing

    dec = decision(ws).where(F.col("category_detail") != "Industrial")  # one category without a backtest
    cats = st.mbase(ws).select("category_detail").distinct()
    return landing.src_decision(ws.spark, dec, cats, ws.params.backtest.segment, ws.params.projection)


# -- cells' summaries -------------------------------------------------------


@query("agg_fallback_share", f"""
SELECT grouping, model, fallback, {r("sum(vol_actual)", 4)} AS vol, count(*) AS n, {r("sum(vol_actual) / sum(sum(vol_actual)) OVER (PARTITION BY grouping, model)", 6)} AS share
FROM cells WHERE scenario = 'realizado' GROUP BY 1, 2, 3""")
def _(ws):
    return out(ev.agg_fallback_share(plain_cells(ws)), 6, vol=4)


@query("agg_real_x_forecast", f"""
SELECT grouping, scenario, model, region_adj, category_detail, territory, period, {", ".join(r(f"sum({c})", 4) + f" AS {c}" for c in CELLD)} FROM cells GROUP BY ALL""")
def _(ws):
    return out(ev.agg_real_x_forecast(plain_cells(ws)))


@query("agg_total_series", f"""
SELECT grouping, period, {r("sum(vol_raw) / 1e6", 9)} AS vol, 'real' AS kind, NULL AS scenario, NULL AS model FROM ts WHERE period >= {lit(fcs.shift_date(TRAIN, -12))} AND NOT filled GROUP BY 1, 2
UNION ALL SELECT grouping, period, {r("sum(vol_fit) / 1e6", 9)}, 'forecast', scenario, model FROM cells GROUP BY grouping, period, scenario, model""")
def _(ws):
    return out(ev.agg_total_series(st.ts(ws), plain_cells(ws), fcs.shift_date(st.train_end(ws), -12)), 9)


# -- external forecast ------------------------------------------------------

cte("ext_map", """
SELECT *, CASE WHEN region_adj LIKE 'SP\\_%' ESCAPE '\\' THEN 'M' WHEN region_adj = 'OC' THEN 'OCOS' ELSE region_adj END AS er, CASE WHEN category_detail LIKE 'Residencial Social%' THEN 'RESIDENCIAL SOCIAL'
  ELSE replace(upper(category_detail), 'Ú', 'U') END AS ec FROM (SELECT region_adj, category_detail, territory, period, sum(vol) AS vol_actual, sum(units) AS units FROM keys GROUP BY 1, 2, 3, 4)""")
cte("ext_cells", f"""
SELECT scenario, region_adj, category_detail, territory, m.period, units, vol_actual, c * units AS vol_fit, c IS NOT NULL AS covered FROM ext_map m
LEFT JOIN (SELECT ext_region AS er, replace(upper(ext_category), 'Ú', 'U') AS ec, period, sum(vol) / nullif(sum(units), 0) AS c FROM ext GROUP BY 1, 2, 3) e
  ON e.er = m.er AND e.ec = m.ec AND e.period = m.period
CROSS JOIN (SELECT unnest({list(SCENS)}) AS scenario) WHERE m.period BETWEEN {lit(CUT)} AND {lit(TEST_END)}""")


def ext_cells(ws):
    from .q_sources import external

    return ev.acc_external(external(ws), st.peaked(ws), ws.params.backtest.cut, st.test_end(ws), SCENS)


@query("prj_ext_map", "SELECT DISTINCT region_adj, category_detail, er AS ext_region, CASE WHEN category_detail LIKE 'Residencial Social%' THEN 'Residencial Social' ELSE category_detail END AS ext_category FROM ext_map")
def _(ws):
    return ev.prj_ext_map(st.peaked(ws).select("region_adj", "category_detail").distinct())


@query("acc_external", f"""
SELECT 'LCA' AS grouping, scenario, 'LCA' AS model, region_adj, category_detail, territory, period, {r("units", 4)} AS units, {r("vol_actual", 4)} AS vol_actual,
  {r("vol_fit", 4)} AS vol_fit FROM ext_cells WHERE covered""")
def _(ws):
    return out(ext_cells(ws).where("covered").drop("covered"))


@query("acc_external_coverage", f"SELECT scenario, {r('sum(CASE WHEN covered THEN vol_actual ELSE 0 END) / sum(vol_actual)', 6)} AS share_covered FROM ext_cells GROUP BY 1")
def _(ws):
    return out(ev.ext_coverage(ext_cells(ws)), 6)


# -- elasticities on simple regressions ------------------------------------

TERMS_DDL = [("term", "string"), ("column", "string"), ("variable", "string"), ("expected_sign", "int")]


def terms(ws):
    from metermill.sources.values import relation

    return relation(ws.spark, TERMS_DDL, rules.TERMS)


def simple_coefs(ws):
    """One-regressor slopes in logs per series: coefficients SQL can repeat."""
    train = st.ts(ws).where((F.col("period") <= F.lit(st.train_end(ws))))
    cols = [("log(temp_med)", "temp_med"), ("log(prec_tot)", "prec_tot")]
    y = F.ln("consumption")
    g = train.join(st.info(ws).where("eligible").select(*GROUPED), GROUPED, "left_semi").groupBy(*GROUPED).agg(
        *[F.regr_slope(y, F.ln(c)).alias(f"b_{c}") for _, c in cols], *[F.regr_r2(y, F.ln(c)).alias(f"r_{c}") for _, c in cols]
    )
    cells = F.explode(F.array(*[
        F.struct(F.lit(t).alias("term"), F.col(f"b_{c}").alias("estimate"), (1 - F.col(f"r_{c}")).alias("p_value")) for t, c in cols
    ]))
    raw = g.select(*GROUPED, F.lit("arima_2").alias("model"), cells.alias("c")).select(*GROUPED, "model", "c.*")
    return ws.stage("simple_coefs", lambda: ev.el_coef(raw, train, terms(ws)))


cte("coef0", f"""
SELECT {K5}, 'arima_2' AS model, 'log(temp_med)' AS term, 'Temperatura' AS variable, 1 AS expected_sign, regr_slope(ln(consumption), ln(temp_med)) AS estimate, 1 - regr_r2(ln(consumption), ln(temp_med)) AS p_value
FROM ts SEMI JOIN (SELECT * FROM info WHERE eligible) USING ({K5}) WHERE period <= {lit(TRAIN)} GROUP BY {K5}
UNION ALL SELECT {K5}, 'arima_2', 'log(prec_tot)', 'Precipitação', -1, regr_slope(ln(consumption), ln(prec_tot)), 1 - regr_r2(ln(consumption), ln(prec_tot))
FROM ts SEMI JOIN (SELECT * FROM info WHERE eligible) USING ({K5}) WHERE period <= {lit(TRAIN)} GROUP BY {K5}""")
cte("coef_w", f"SELECT {K5}, coalesce(sum(vol_adj), 0) AS weight FROM (SELECT * FROM ts WHERE period <= {lit(TRAIN)} QUALIFY row_number() OVER (PARTITION BY {K5} ORDER BY period DESC) <= 12) GROUP BY {K5}")
cte("coefs", f"""
SELECT c.*, weight, coalesce(p_value <= 0.05, FALSE) AS significant, sign(estimate) = expected_sign AS sign_ok,
  estimate < q1 - 2 * (q3 - q1) OR estimate > q3 + 2 * (q3 - q1) AS outlier
FROM coef0 c LEFT JOIN coef_w USING ({K5}) JOIN (SELECT grouping, model, term, quantile_cont(estimate, 0.25) AS q1, quantile_cont(estimate, 0.75) AS q3 FROM coef0 GROUP BY 1, 2, 3) q
USING (grouping, model, term)""")


@query("win_iqr", f"SELECT {K5}, model, term, {r('estimate', 5)} AS estimate, outlier, significant, sign_ok, {r('weight', 4)} AS weight FROM coefs")
def _(ws):
    return out(simple_coefs(ws).select(*GROUPED, "model", "term", "estimate", "outlier", "significant", "sign_ok", "weight"), 5, weight=4)


def el_sql(dims):
    d_ = "".join(f"{x}, " for x in dims)
    ok = "FILTER (NOT outlier)"
    return f"""SELECT grouping, model, variable, term, {d_} count(*) AS n_series, count(*) FILTER (outlier) AS n_outliers,
  {r(f"quantile_cont(estimate, 0.5) {ok}", 5)} AS median, {r(f"sum(estimate * weight) {ok} / nullif(sum(weight) {ok}, 0)", 5)} AS weighted_mean,
  {r(f"quantile_cont(estimate, 0.25) {ok}", 5)} AS p25, {r(f"quantile_cont(estimate, 0.75) {ok}", 5)} AS p75,
  {r(f"avg(CASE WHEN significant THEN 1.0 ELSE 0.0 END) {ok}", 5)} AS share_significant, {r(f"avg(CASE WHEN sign_ok THEN 1.0 ELSE 0.0 END) {ok}", 5)} AS share_expected_sign
FROM coefs GROUP BY ALL"""


@query("el_summary", el_sql(("category_detail", "territory")))
def _(ws):
    return out(ev.el_summary(simple_coefs(ws), ["category_detail", "territory"]), 5)


@query("agg_magnitude", f"""
WITH v AS (SELECT category_detail AS cd, month(period) AS mon, sum(vol_meas_water) AS x FROM mbase WHERE year(period) = (SELECT max(year(period)) FROM mbase) GROUP BY 1, 2),
s AS (SELECT cd, mon, x / sum(x) OVER (PARTITION BY mon) AS sh FROM v)
SELECT cd AS category_detail, {", ".join(r(f"max(sh) FILTER (mon = {m})", 5) + f" AS m{m:02d}" for m in range(1, 8))} FROM s GROUP BY 1""")
def _(ws):
    from metermill.operators import reports

    return out(reports.agg_magnitude(st.mbase(ws), "category_detail", "vol_meas_water", range(1, 8), True), 5)

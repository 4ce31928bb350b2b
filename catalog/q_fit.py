"""Queries on the fitted catalogue: an estimator has no SQL equivalent, so most
give rows only; their deterministic parts are checked elsewhere."""

import functools

from pyspark.sql import DataFrame, functions as F

from metermill import rules
from metermill.operators import evaluate as ev
from metermill.operators import fit
from metermill.operators import forecast as fcs
from metermill.operators import projection as pj
from metermill.operators import series
from metermill.operators.series import GROUPED
from metermill.sources import landing
from metermill.sources.values import relation

from . import stages as st
from .q_eval import BY, PLAIN, plain_cells, simple_coefs, terms
from .q_model import CUT, K5, TEST_END, TRAIN, tariff_path
from .q_projection import plain_choice, units_group
from .registry import out, query
from .sqlkit import P, cte, inlist, lit, r, values

SCENS = ("realizado", "base", "quente_seco", "frio_umido")


@query("fc_catalog", f"""
SELECT name, response, regressors, constant, formula, n_series FROM {values("t", "name, response, regressors, constant, formula", fit.fc_catalog())},
  (SELECT count(*) AS n_series FROM info WHERE eligible)""")
def _(ws):
    ddl = [("name", "string"), ("response", "string"), ("regressors", "string"), ("constant", "boolean"), ("formula", "string")]
    n = st.info(ws).where("eligible").agg(F.count("*").alias("n_series"))
    return relation(ws.spark, ddl, fit.fc_catalog()).crossJoin(n)


def train(ws):
    rows = st.ts(ws).where(F.col("period") <= F.lit(st.train_end(ws)))
    return series.jn_semi_keys(rows, st.info(ws).where("eligible"))


def fits(ws):
    def make():
        plan = fit.model_plan(st.info(ws).where("eligible"), ws.params.backtest.models)
        return fit.fc_fit(train(ws), plan)

    return ws.stage("fits", make)


def fc(ws):
    return ws.stage("fc", lambda: fit.fc_predict(fits(ws), st.scenarios(ws)))


def cells(ws):
    """The fitted backtest: forecasts of every model and scenario against actuals."""

    def make():
        b = ws.params.backtest
        fb = fcs.fc_fallback(st.ts(ws), st.test_grid(ws), st.train_end(ws))
        units = None
        if b.test_units == "projected":
            units = fcs.fc_units_series(
                st.ts(ws), st.info(ws), st.train_end(ws), b.cut, st.test_end(ws), b.units_over_categories,
                ws.params.projection.min_obs_units,
            )
        return ev.jn_assemble(st.test_rows(ws), fc(ws), fb, st.info(ws), units, b.models, SCENS, b.actual)

    return ws.stage("cells", make)


def judged(ws):
    return ev.prj_month_merge(cells(ws), ws.params.backtest.merged_months)


def choice(ws):
    def make():
        b = ws.params.backtest
        acc = ev.acc_at(judged(ws), rules.ACCURACY_LEVELS[b.select_level], by=BY).where(F.col("scenario") == b.select_scenario)
        n = st.info(ws).groupBy("grouping").agg(F.count("*").alias("n_series"))
        return ev.sel_choice(ev.win_rank(acc, BY, b.metric), n, BY, b.metric, b.tolerance)

    return ws.stage("choice", make)


def backtested(ws, make):
    """Rows of every segment and backtest target."""
    return st.over_parts(ws, make, ws.params.backtest.targets)


@query("fc_fit")
def _(ws):
    cols = [*GROUPED, "model", "spec", "fitted", "aicc", "sigma2", "n_obs", "n_arma"]
    return out(backtested(ws, lambda p: fits(p).select(*cols)), 6)


@query("fc_predict")
def _(ws):
    return out(backtested(ws, fc))


@query("fc_backtest")
def _(ws):
    return out(backtested(ws, cells))


@query("acc_backtest")
def _(ws):
    return out(backtested(ws, lambda p: ev.acc_levels(judged(p))), 5)


@query("sel_backtest")
def _(ws):
    return out(backtested(ws, choice), 5)


@query("fc_units_test")
def _(ws):
    """Units of the test months by the damped trend (the 'projected' option)."""
    b = ws.params.backtest
    return out(fcs.fc_units_series(
        st.ts(ws), st.info(ws), st.train_end(ws), b.cut, st.test_end(ws), b.units_over_categories, ws.params.projection.min_obs_units
    ))


def coefs(ws):
    return ws.stage("coefs", lambda: ev.el_coef(fit.raw_coefficients(fits(ws)), train(ws), terms(ws)))


@query("el_coef")
def _(ws):
    return out(backtested(ws, coefs), 5)


def diag(ws):
    return ws.stage("diag", lambda: fit.dg_series(fits(ws), judged(ws), ws.params.backtest.select_scenario))


@query("dg_series")
def _(ws):
    return out(backtested(ws, diag), 5)


@query("dg_summary")
def _(ws):
    return out(backtested(ws, lambda p: ev.dg_summary(diag(p), ev.agg_fallback_share(cells(p)), fit.best_models(choice(p)))), 5)


def specs(ws):
    """Text specifications SQL can repeat: model and coefficient sign."""
    sign = F.when(F.col("estimate") > 0, "+").otherwise("-")
    return simple_coefs(ws).withColumn("spec", F.concat("category_detail", F.lit(" "), sign))


@query("top_modes", f"""
SELECT grouping, model, string_agg(spec, ' | ' ORDER BY rn) AS common_specs FROM (SELECT grouping, model, spec, row_number() OVER (PARTITION BY grouping, model ORDER BY count(*) DESC, spec) AS rn
  FROM (SELECT grouping, model, category_detail || ' ' || CASE WHEN estimate > 0 THEN '+' ELSE '-' END AS spec FROM coefs) GROUP BY 1, 2, 3) WHERE rn <= 3 GROUP BY 1, 2""")
def _(ws):
    return ev.top_modes(specs(ws), ["grouping", "model"])


@query("jn_right", """
SELECT grouping, model, n_series FROM (SELECT grouping, model, count(*) AS n_series FROM coefs GROUP BY 1, 2) RIGHT JOIN (SELECT DISTINCT grouping, model FROM pick) USING (grouping, model)""")
def _(ws):
    from .q_eval import choice as plain

    stats = simple_coefs(ws).groupBy("grouping", "model").agg(F.count("*").alias("n_series"))
    return ev.jn_right(stats, fit.best_models(plain(ws)))


@query("fc_refit", f"""
WITH t AS (SELECT {K5}, period, substr(md5(concat_ws('|', {K5})), 1, 1) < '8' AS late FROM ts WHERE period <= {lit(TRAIN)} AND ({K5}) IN (SELECT ({K5}) FROM info WHERE eligible))
SELECT {K5}, CASE WHEN bool_or(period < {lit(TRAIN)}) THEN 'data' ELSE 'new' END AS reason FROM t GROUP BY {K5}
HAVING bool_or(late AND period = {lit(TRAIN)})""")
def _(ws):
    """Which stored fits are no longer valid?  In the stored training set about half of the series lack the last month."""
    formulas = {m: rules.MODELS[m].formula for m in ws.params.backtest.models}
    late = F.substring(F.md5(F.concat_ws("|", *GROUPED).cast("binary")), 1, 1) < "8"
    rows = train(ws)
    old = rows.where(~(late & (F.col("period") == F.lit(st.train_end(ws)))))
    return fit.refit_due(series.ts_fingerprint(old, formulas), series.ts_fingerprint(rows, formulas))


# -- projection with fitted models ------------------------------------------


def keys_proj(ws):
    b = ws.params.backtest
    return ws.stage("keys_proj", lambda: series.ts_key_prep(st.mbase(ws), b.target, st.test_end(ws), b.treat_outliers, b.clean_units))


def ts_proj(ws):
    b = ws.params.backtest
    grouped = series.prj_grouping(keys_proj(ws), b.groupings, ws.params.grouping)
    return ws.stage("ts_proj", lambda: series.ts_group(grouped, st.exog(ws)))


def info_proj(ws):
    p = ws.params.projection
    return ws.stage("info_proj", lambda: series.agg_series_info(ts_proj(ws), st.test_end(ws), p.min_obs_model))


def decided(ws):
    """Grouping and model of every category of a segment x target: its backtest, the measured sibling's, the default."""

    def make():
        b, w = ws.params.backtest, ws.whole
        seg = next(s for s in ws.params.segments if s.name == b.segment)
        measured = rules.MEASURED_SIBLING.get(b.target, b.target)
        own = choice(w.part(w.params.part(seg, measured))).where("chosen")
        dec = own.select(F.lit(seg.name).alias("segment"), F.lit(measured).alias("target"), "category_detail", "grouping", "model")
        cats = st.mbase(ws).select("category_detail").distinct()
        return landing.src_decision(ws.spark, dec, cats, seg.name, ws.params.projection).where(F.col("target") == b.target)

    return ws.stage("decided", make)


def chosen_proj(ws):
    return ws.stage("chosen_proj", lambda: pj.chosen_series(info_proj(ws), decided(ws)))


def fits_proj(ws):
    """One fit per series: only the chosen model, on the whole history."""

    def make():
        past = ts_proj(ws).where(F.col("period") <= F.lit(st.test_end(ws)))
        return fit.fc_fit(series.jn_semi_keys(past, info_proj(ws).where("eligible")), chosen_proj(ws))

    return ws.stage("fits_proj", make)


def scenarios_proj(ws):
    def make():
        p, end, ts = ws.params.projection, st.test_end(ws), ts_proj(ws)
        months = fcs.future_grid(chosen_proj(ws), GROUPED, fcs.shift_date(end, 1), p.last_period)
        ante = ws.stage("exante_proj", lambda: fcs.sc_exante(ts, months, end))
        return ante.unionByName(fcs.sc_apply(ante.where("scenario = 'base'"), fcs.sc_anomaly(ts, p), p, "el_nino"))

    return ws.stage("scenarios_proj", make)


def project(ws):
    """Each category with its chosen grouping and model, all in one job."""

    def make():
        p, end, ts = ws.params.projection, st.test_end(ws), ts_proj(ws)
        grid = pj.project_grid(chosen_proj(ws), end, p.last_period, p.scenarios)
        forecast = fit.fc_predict(fits_proj(ws), scenarios_proj(ws))
        months = fcs.future_grid(chosen_proj(ws), GROUPED, fcs.shift_date(end, 1), p.last_period)
        fb = fcs.fc_fallback(ts, months, end)
        return pj.fc_volume(
            grid, forecast, fb, info_proj(ws), units_group(ws), fcs.fc_tariff_factor(tariff_path(ws), ws.spark, p)
        )

    return ws.stage("project", make)


@query("fc_project")
def _(ws):
    return out(st.over_parts(ws, project, ws.params.projection.targets))


def fitted_monthly(ws):
    """Monthly result of one segment x target."""
    p, b = ws.params.projection, ws.params.backtest
    chosen = decided(ws).select("category_detail", "grouping")
    real = series.ts_impute_hist(ts_proj(ws).join(chosen, ["category_detail", "grouping"], "left_semi"), st.test_end(ws), p.max_imputed_run)
    return pj.agg_mensal(project(ws), real, p.scenarios, b.segment, b.target)


@query("agg_project_annual")
def _(ws):
    """Annual result of the fitted projection."""
    months = st.each_part(ws, fitted_monthly, ws.params.projection.targets)
    return out(pj.agg_annual(functools.reduce(DataFrame.unionByName, months)))

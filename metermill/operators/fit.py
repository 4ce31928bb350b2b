"""The fitted model catalogue.  Spark spreads series x model over tasks; one
task fits one short monthly series at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import regression as reg
from ..functions.dates import month_index
from ..plans.shipping import ship
from ..rules import MODELS, TERMS
from .evaluate import series_accuracy
from .series import GROUPED

TERM_OF = {c: t for t, c, _, _ in TERMS}
KEY_DDL = "grouping string, region_adj string, `group` string, category_detail string, territory string, model string"
FIT_DDL = (
    KEY_DDL + ", spec string, fitted boolean, aicc double, sigma2 double, n_obs int, n_arma int, d int, sd int, "
    "last_month int, const double, columns array<string>, terms array<string>, beta array<double>, "
    "p_value array<double>, ar_lags array<int>, ar array<double>, ma_lags array<int>, ma array<double>, "
    "y_tail array<double>, x_tail array<double>, u_tail array<double>, e_tail array<double>, residuals array<double>"
)
FIT_NAMES = [f.split()[0].strip("`") for f in FIT_DDL.split(", ")]
TAIL = 26  # months a forecast looks back at most


def fc_catalog(names: Sequence[str] | None = None) -> list[tuple]:
    """The catalogue as rows: name, response, regressors, constant, formula."""
    return [
        (m.name, m.response, ",".join(m.regressors), m.constant, m.formula)
        for m in MODELS.values() if names is None or m.name in names
    ]


def _fit_one(s, spec) -> dict | None:
    """Fields of one fit, or None.  ``s`` holds the series' months as arrays."""
    with np.errstate(divide="ignore", invalid="ignore"):
        y = np.log(np.asarray(getattr(s, spec.response), float))
        cols = [np.asarray(getattr(s, c), float) for c in spec.regressors]
        x = np.log(np.column_stack(cols)) if cols else np.zeros((len(y), 0))
    months = np.asarray(s.period_no, int)
    last = int(months[-1])
    if spec.seasonal_naive:
        if len(y) < reg.SEASON or not np.isfinite(y[-reg.SEASON :]).all():
            return None
        resid = y[reg.SEASON :] - y[: -reg.SEASON]
        return {
            "spec": "SNAIVE", "sigma2": float(resid.var()) if len(resid) else 0.0, "n_obs": len(y), "n_arma": 0,
            "last_month": last, "y_tail": y[-reg.SEASON :], "residuals": resid, "columns": [], "terms": [],
        }
    try:
        m = reg.fit(y, x, months % 12 + 1, spec.d, spec.seasonal_d, spec.constant)
    except np.linalg.LinAlgError:
        return None
    if m is None:
        return None
    return {
        "spec": reg.spec_text(m, x.shape[1]), "aicc": m["aicc"], "sigma2": m["sigma2"],
        "n_obs": len(y), "n_arma": len(m["ar"][0]) + len(m["ma"][0]), "d": m["order"][1], "sd": m["order"][4],
        "last_month": last, "const": m["const"], "columns": list(spec.regressors),
        "terms": [TERM_OF[c] for c in spec.regressors], "beta": m["beta"],
        "p_value": [None if np.isnan(v) else v for v in m["p_value"]],
        "ar_lags": m["ar"][0], "ar": m["ar"][1], "ma_lags": m["ma"][0], "ma": m["ma"][1],
        "y_tail": y[-TAIL:], "x_tail": x[-TAIL:].ravel(), "u_tail": m["u"][-TAIL:],
        "e_tail": m["e"][-TAIL:], "residuals": m["e"][reg.START :],
    }


def _fit_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for s in pdf.itertuples(index=False):
            keys = {c: getattr(s, c) for c in (*GROUPED, "model")}
            got = _fit_one(s, MODELS[s.model])
            rows.append({**keys, "spec": "NULL model", "fitted": got is not None, **(got or {})})
        frame = pd.DataFrame(rows, columns=FIT_NAMES, dtype=object)
        yield frame.where(frame.notna(), None)


def _tasks(df: DataFrame) -> int:
    """Fits cost CPU, not bytes: keep every shuffle partition instead of letting
    small ones merge."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def model_plan(series: DataFrame, models: Sequence[str]) -> DataFrame:
    """Every series with every model of a list."""
    return series.select(*GROUPED, F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))


def _packed(rows: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per key: its months as parallel arrays in time order.  A key has
    one entry per calendar month, so the arrays are short."""
    obs = F.array_sort(F.collect_list(F.struct("period_no", *cols)))
    packed = rows.withColumn("period_no", month_index("period")).groupBy(*keys).agg(obs.alias("_o"))
    return packed.select(*keys, *[F.col("_o").getField(c).alias(c) for c in ("period_no", *cols)])


def fc_fit(train: DataFrame, plan: DataFrame) -> DataFrame:
    """Parameters of every series x model of the plan, one row each."""
    packed = _packed(train, GROUPED, ["consumption", "volume", *TERM_OF])
    ship(train.sparkSession)
    work = packed.join(plan.select(*GROUPED, "model"), GROUPED).repartition(_tasks(train), *GROUPED, "model")
    return work.mapInPandas(_fit_batches, FIT_DDL)


def _forecast(s) -> np.ndarray | None:
    h = np.asarray(s.period_no, int) - int(s.last_month)
    if s.spec == "SNAIVE":
        return np.exp(np.asarray(s.y_tail, float)[(h - 1) % reg.SEASON])
    if not (h == np.arange(1, len(h) + 1)).all():
        return None  # the forecast months must follow the history
    cols = list(s.columns_)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.log(np.column_stack([np.asarray(getattr(s, c), float) for c in cols])) if cols else np.zeros((len(h), 0))
    state = {
        "d": int(s.d), "sd": int(s.sd), "const": float(s.const_), "sigma2": float(s.sigma2),
        "beta": np.asarray(s.beta, float), "y_tail": list(s.y_tail), "u_tail": list(s.u_tail), "e_tail": list(s.e_tail),
        "ar": list(zip(s.ar_lags, s.ar)), "ma": list(zip(s.ma_lags, s.ma)),
        "x_tail": np.asarray(s.x_tail, float).reshape(len(s.y_tail), len(cols)),
    }
    return reg.predict(state, x)


def _predict_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        values = [_forecast(s) for s in pdf.itertuples(index=False)]
        out = pdf[[*GROUPED, "model", "scenario", "period"]].copy()
        out["forecast"] = pd.Series(values, index=out.index, dtype=object)
        yield out


def fc_predict(fits: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Forecasts per series x model x scenario, mean on the original scale."""
    ship(fits.sparkSession)
    scen = _packed(scenarios, [*GROUPED, "scenario"], ["period", *TERM_OF])
    slim = fits.where("fitted").drop("residuals", "p_value", "terms", "aicc")
    slim = slim.withColumnsRenamed({"columns": "columns_", "const": "const_"})
    work = scen.join(slim, GROUPED).repartition(_tasks(fits), *GROUPED, "model", "scenario")
    ddl = KEY_DDL + ", scenario string, period array<date>, forecast array<double>"
    done = work.mapInPandas(_predict_batches, ddl).where(F.col("forecast").isNotNull())
    cells = F.explode(F.arrays_zip("period", "forecast")).alias("c")
    return done.select(*GROUPED, "model", "scenario", cells).select(*GROUPED, "model", "scenario", "c.period", "c.forecast")


def raw_coefficients(fits: DataFrame) -> DataFrame:
    """One row per regressor coefficient."""
    z = F.explode(F.arrays_zip("terms", "beta", "p_value")).alias("c")
    rows = fits.where(F.col("fitted") & (F.size("terms") > 0)).select(*GROUPED, "model", z)
    return rows.select(*GROUPED, "model", F.col("c.terms").alias("term"), F.col("c.beta").alias("estimate"), F.col("c.p_value").alias("p_value"))


@F.pandas_udf(T.DoubleType())
def _chi2_p(q: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or b <= 0 else reg.chi2_upper(a, b) for a, b in zip(q, dof)], dtype=float)


def ljung_box(fits: DataFrame, lags: int = 24) -> DataFrame:
    """Portmanteau statistic of the residuals, and its p-value.

    A series with fewer residuals than lags is tested at the lags it has; without a degree of freedom the p-value is null."""
    r = F.col("residuals")
    n = F.size(r)
    dev = F.transform(r, lambda v: v - F.aggregate(r, F.lit(0.0), lambda a, b: a + b) / n)
    rows = fits.where(F.col("fitted") & (F.size("residuals") > 1)).select(*GROUPED, "model", "n_arma", dev.alias("e"))
    e, n = F.col("e"), F.size("e")
    own = F.least(F.lit(lags), n - 1)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    c0 = dot(e, e)

    def term(k):
        ck = dot(F.slice(e, F.lit(1), n - k), F.slice(e, k + 1, n - k))
        return F.pow(F.try_divide(ck, c0), F.lit(2.0)) / (n - k)

    q = n * (n + 2) * F.aggregate(F.sequence(F.lit(1), own), F.lit(0.0), lambda acc, k: acc + term(k))
    rows = rows.select(*GROUPED, "model", q.alias("lb_stat"), (own - F.col("n_arma")).alias("dof"))
    return rows.withColumn("lb_p_value", _chi2_p("lb_stat", "dof")).drop("dof")


def dg_series(fits: DataFrame, cells: DataFrame, scenario: str) -> DataFrame:
    """Specification, fit and test accuracy per series x model."""
    keys = [*GROUPED, "model"]
    lb = ljung_box(fits).select(*keys, "lb_stat", "lb_p_value")
    return (
        fits.select(*keys, "spec", "aicc", "sigma2")
        .join(lb, keys, "left")
        .join(series_accuracy(cells, scenario), keys, "left")
    )


def best_models(choice: DataFrame) -> DataFrame:
    return choice.where("chosen").select("grouping", "model").distinct()


def refit_due(stored: DataFrame, current: DataFrame) -> DataFrame:
    """The series whose fit is not that of today's training set, with the reason: new, gone, models or data.

    Both are signatures by series (``ts_fingerprint``); the training sets are not read again, and unchanged series keep their fit.
    """
    marks = ["n_rows", "sum_a", "xor_a", "sum_b", "xor_b"]
    old = stored.select(*GROUPED, *[F.col(c).alias(f"_{c}") for c in (*marks, "formulas")], F.lit(True).alias("_old"))
    now = current.select(*GROUPED, *marks, "formulas", F.lit(True).alias("_now"))
    same = None
    for c in GROUPED:
        eq = F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
        same = eq if same is None else same & eq
    rows = now.alias("n").join(old.alias("o"), same, "full")
    data = None
    for c in marks:
        ne = F.col(c) != F.col(f"_{c}")
        data = ne if data is None else data | ne
    reason = (
        F.when(F.col("_old").isNull(), "new").when(F.col("_now").isNull(), "gone").when(F.col("formulas") != F.col("_formulas"), "models").when(data, "data")
    )
    keys = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in GROUPED]
    return rows.select(*keys, reason.alias("reason")).where(F.col("reason").isNotNull())

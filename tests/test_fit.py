"""Estimators on generated series with known coefficients."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from metermill.functions import regression as reg
from metermill.operators import fit, forecast as fcs
from metermill.operators.series import GROUPED


def month(i):
    return date(2018 + i // 12, i % 12 + 1, 1)


def generated(spark, n_series=6, n=96):
    rng = np.random.default_rng(11)
    rows = []
    for s in range(n_series):
        u = 0.0
        for i in range(n):
            temp = 20 + 5 * np.sin(2 * np.pi * i / 12) + rng.normal(0, 1.5)
            rain, jobs = 4 + 2 * rng.random(), 1000 + i
            u = 0.4 * u + rng.normal(0, 0.01)
            cons = float(np.exp(1.0 + 0.5 * np.log(temp) - 0.1 * np.log(rain) + u))
            rows.append(("G", "R", f"s{s}", "D", "T", month(i), cons, cons * 50, float(temp), float(rain), float(jobs)))
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in GROUPED) + ", period date, consumption double, volume double, temp_med double, prec_tot double, jobs double")


def test_coefficients_and_forecasts(spark):
    ts = generated(spark)
    cut = month(84)
    train, test = ts.where(F.col("period") < F.lit(cut)), ts.where(F.col("period") >= F.lit(cut))
    plan = fit.model_plan(ts.select(*GROUPED).distinct(), ["snaive", "arima_2", "vol_arima_2"])
    fits = fit.fc_fit(train, plan)
    assert fits.where("fitted").count() == 18
    coefs = {r.term: r.m for r in fit.raw_coefficients(fits.where("model = 'arima_2'")).groupBy("term").agg(F.avg("estimate").alias("m")).collect()}
    assert coefs["log(temp_med)"] == pytest.approx(0.5, abs=0.06)
    assert coefs["log(prec_tot)"] == pytest.approx(-0.1, abs=0.04)
    fc = fit.fc_predict(fits, test.withColumn("scenario", F.lit("realizado")))
    err = fc.join(test, [*GROUPED, "period"]).withColumn("f", F.when(F.col("model").startswith("vol_"), F.col("forecast") / 50).otherwise(F.col("forecast")))
    mape = {r.model: r.e for r in err.groupBy("model").agg(F.avg(F.abs(F.col("f") / F.col("consumption") - 1)).alias("e")).collect()}
    assert mape["arima_2"] < 0.02 < mape["snaive"]
    assert mape["vol_arima_2"] < 0.02
    lb = fit.ljung_box(fits.where("model = 'arima_2'")).collect()
    assert len(lb) == 6 and all(0 <= r.lb_p_value <= 1 for r in lb)


def test_short_series_have_no_model(spark):
    ts = generated(spark, 1, 20)
    r = fit.fc_fit(ts, fit.model_plan(ts.select(*GROUPED).distinct(), ["arima_2"])).first()
    assert (r.spec, r.fitted) == ("NULL model", False)


def test_chi_square_tail():
    for x, k, p in ((3.841459, 1, 0.05), (36.41503, 24, 0.05), (10.0, 20, 0.9681719), (0.0, 3, 1.0)):
        assert reg.chi2_upper(x, k) == pytest.approx(p, abs=1e-6)


def test_damped_trend_follows_growth(spark):
    rows = [("a", month(i), 1000.0 * 1.01**i) for i in range(40)] + [("b", month(i), 5.0) for i in range(40)] + [("c", month(39), 1.0)]
    df = spark.createDataFrame(rows, "k string, period date, total double")
    got = {(r.k, r.period): r.forecast for r in fcs.fc_damped(df, ["k"], "total", month(40), month(41), 24).collect()}
    assert got[("a", month(40))] == pytest.approx(1000 * 1.01**40, rel=0.01)
    assert got[("b", month(41))] == pytest.approx(5.0)
    assert ("c", month(40)) not in got


def planted(a, b, f, n=60):
    """A flat log series with one shock: from then on its path shows the three parameters, without noise."""
    level, slope, y = 5.0, 0.0, [5.0]
    for i in range(n - 1):
        e = 0.5 if i == 12 else 0.0
        base = level + f * slope
        y.append(base + e)
        level, slope = base + a * e, f * slope + b * e
    return y


def squared_error(y, a, b, f):
    level, slope, total = y[0], (y[11] - y[0]) / 11, 0.0
    for x in y[1:]:
        base = level + f * slope
        e = x - base
        level, slope, total = base + a * e, f * slope + b * e, total + e * e
    return total


def test_damped_trend_finds_parameters_off_the_grid(spark):
    rng = np.random.default_rng(8)
    truth = [(float(rng.uniform(0.1, 0.9)), float(rng.uniform(0.02, 0.4)), float(rng.uniform(0.81, 0.97))) for _ in range(12)]
    noisy = [[float(v) for v in 4 + np.cumsum(rng.normal(0.01, 0.03, 50))] for _ in range(12)]
    series = [planted(*t) for t in truth] + noisy
    df = spark.createDataFrame([(i, y) for i, y in enumerate(series)], "i int, y array<double>")
    got = {r.i: r.m for r in df.select("i", fcs.damped_fit(F.col("y")).alias("m")).collect()}
    grid = [g for _, *g in fcs.damped_grid()]
    for i, y in enumerate(series):
        m = got[i]
        found = tuple(v / fcs.UNIT for v in (m.a, m.b, m.f))
        if i < len(truth):
            assert np.abs(np.array(found) - truth[i]).max() <= 0.01
        assert m.sse <= min(squared_error(y, *g) for g in grid) + 1e-9 and m.sse == pytest.approx(squared_error(y, *found), abs=2e-9)


def test_every_history_from_the_minimum_on_is_fitted():
    rng = np.random.default_rng(5)
    for n in range(reg.MIN_MONTHS, 44):
        months = np.arange(n) % 12 + 1
        y = 3 + 0.01 * np.arange(n) + 0.1 * np.sin(months) + rng.normal(0, 0.02, n)
        for d, sd in ((0, 0), (0, 1), (1, 0), (1, 1)):
            assert reg.fit(y, np.zeros((n, 0)), months, [d], [sd], True) is not None, (n, d, sd)


def test_short_fits_get_a_ljung_box_value(spark):
    keys = {c: "k" for c in GROUPED}
    rng = np.random.default_rng(3)
    rows = [{**keys, "group": str(n), "model": "m", "fitted": True, "n_arma": 2, "residuals": [float(v) for v in rng.normal(size=n)]} for n in (1, 3, 4, 10, 24, 25, 60)]
    ddl = ", ".join(f"`{c}` string" for c in (*GROUPED, "model")) + ", fitted boolean, n_arma int, residuals array<double>"
    got = {int(r.group): r for r in fit.ljung_box(spark.createDataFrame(rows, ddl)).collect()}
    assert set(got) == {3, 4, 10, 24, 25, 60} and got[3].lb_p_value is None
    for row in rows[2:]:
        e = np.array(row["residuals"]) - np.mean(row["residuals"])
        n, lags = len(e), min(24, len(e) - 1)
        q = n * (n + 2) * sum((e[k:] @ e[:-k] / (e @ e)) ** 2 / (n - k) for k in range(1, lags + 1))
        assert got[n].lb_stat == pytest.approx(q) and got[n].lb_p_value == pytest.approx(reg.chi2_upper(q, lags - 2))

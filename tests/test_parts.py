"""The fitted queries run every model, segment and target."""

import __spark_entry__ as e
from metermill import rules

SF = "/root/testdata/sf0.001"


def parts_of(df):
    return {(r.segment, r.target) for r in df.select("segment", "target").distinct().collect()}


def test_backtest_runs_all_models_segments_and_targets(spark):
    fits = e.queries()["fc_fit"](spark, SF).cache()
    assert parts_of(fits) == {(s, t) for s in ("Residencial", "Nao_Residencial") for t in ("med_agua", "med_esg")}
    assert {r.model for r in fits.select("model").distinct().collect()} == set(rules.MODELS)
    fitted = {r.model for r in fits.where("fitted").select("model").distinct().collect()}
    assert fitted == set(rules.MODELS)


def test_projection_runs_all_targets(spark):
    annual = e.queries()["agg_project_annual"](spark, SF)
    assert parts_of(annual) == {(s, t) for s in ("Residencial", "Nao_Residencial") for t in rules.TARGETS}

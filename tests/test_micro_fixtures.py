"""Hand-written fixtures; expected values worked out by hand."""

from dataclasses import replace
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import Row, functions as F

from metermill import schemas
from metermill.operators import accounts, covariates, evaluate, facts, projection, rebalance, series, territory
from metermill.params import AbsurdParams, BaseParams, CovariateParams, SizeParams, TariffParams
from metermill.sources import driver_tables as src
from metermill.sources.values import relation

BILL = dict(
    account="7", contract=1, issue_date=date(2025, 1, 20), year=2025, month=1, office=10, benefit_type="0",
    product_code="SB_NORMAL", class_code="SB_X", usage_code="1", water_item="SB_AGUA_RES", sewage_item=None, units=3, days=30,
    meas_water=Decimal(20), meas_sewage=Decimal(0), meas_effluent=Decimal(0), bill_water_pos=Decimal(20),
    bill_water_neg=Decimal(0), bill_sewage_pos=Decimal(0), bill_sewage_neg=Decimal(0), bill_effluent_pos=Decimal(0),
    bill_effluent_neg=Decimal(0), processed="S",
)


def bills(spark, *changes):
    return spark.createDataFrame([{**BILL, **c} for c in changes], schemas.BILLS)


def fact_of(spark, df):
    reg = spark.createDataFrame([("7", "Urbano", None, 2), ("7", "Rural", date(2024, 1, 1), 1)], schemas.REGISTRY)
    return facts.agg_account_month(facts.coded_bills(df), facts.win_latest(reg))


def test_exact_copies_leave(spark):
    df = bills(spark, {}, {}, {"bill_water_pos": Decimal(21)}, {"processed": "N"})
    assert facts.prj_dedup(df).count() == 2


def test_units_are_a_stock_and_volumes_add(spark):
    df = bills(spark, {}, {"contract": 2, "meas_effluent": None}, {"contract": 3, "units": 2})
    row = fact_of(spark, df).collect()
    assert len(row) == 1
    assert (row[0].units, row[0].n_bills, row[0].vol_meas_water) == (3, 3, Decimal(60))
    assert row[0].vol_meas_sewage == Decimal(0)
    assert row[0].territory == "Rural"  # an open end date comes last


CLASSES = [
    ("PO", dict(product_code="SB_PUBLICA_MUN_O")), ("SA", dict(product_code="SB_PREDIO")), ("RS2", dict(product_code="SB_SOCIAL_2_SR")),
    ("RS2", dict(benefit_type="19", class_code="SB_SOC_50_4")), ("RST1", dict(product_code="SB_SOCIAL_9", benefit_type="16")),
    ("RST1", dict(benefit_type="-1", class_code="SB_SOC_50_1")), ("RST2", dict(product_code="SB_SOCIAL_9", benefit_type="17")),
    ("RF", dict(water_item="SB_AGUA_FAV", product_code="SB_FAVELAS_N")), ("AT", dict(water_item="SB_AGUA_PER")),
    ("CA", dict(water_item="SB_AGUA_COM", class_code="SB_C_AS_1")), ("CE", dict(water_item="SB_AGUA_COM_D", class_code="SB_ESPECIAL")),
    ("C", dict(water_item="SB_AGUA_COM")), ("I", dict(water_item="SB_AGUA_CIP", class_code="X_INDUS")),
    ("C", dict(water_item="SB_AGUA_CIP", class_code="X_COMER")), ("C", dict(water_item="SB_AGUA_CIP", usage_code="2")),
    ("I", dict(water_item="SB_AGUA_CIP", usage_code="3")), ("_NA", dict(water_item="SB_AGUA_CIP", usage_code="9")),
    ("CD", dict(water_item="SB_AGUA_DF", usage_code="2")), ("ID", dict(water_item="SB_AGUA_DFN", usage_code="3")),
    ("_NA", dict(water_item="SB_AGUA_PERS_M", usage_code="4")), ("REUSO", dict(water_item="SB_REUSO")), ("REUSO", dict(water_item="SB_AGUA_MIN")),
    ("RST1", dict(water_item="SB_AGUA_SOC", class_code="SB_SOC_50")), ("RST2", dict(water_item="SB_AGUA_SOC_2", class_code="SB_SOC_75")),
    ("RS", dict(water_item="SB_AGUA_SOC")), ("CAM", dict(water_item="SB_AGUA_CAM")), ("EMB", dict(water_item="SB_AGUA_EMB")),
    ("RV", dict(water_item="SB_AGUA_FAV")), ("PP", dict(water_item="SB_AGUA_PUB", class_code="SB_PUB_CON_PR_1")),
    ("PC", dict(water_item="SB_AGUA_PUB_M", class_code="SB_PURA")), ("P", dict(water_item="SB_AGUA_PUB", class_code=None)),
    ("RE", dict(class_code="SB_R_ESPECIAL")), ("R", dict()), ("I", dict(water_item="SB_AGUA_IND")),
    ("R", dict(water_item=None)), ("C", dict(water_item=None, usage_code="2")), ("I", dict(water_item="SB_AGUA_NOR_1F", usage_code="3")),
    ("P", dict(water_item=None, sewage_item="SB_ESG_ND_ESP_4F", usage_code="4")), (None, dict(water_item="SB_AGUA_XYZ")),
    (None, dict(water_item=None, usage_code="7")),
    # overlaps: product and benefit win over the item
    ("RS2", dict(product_code="SB_SOCIAL_2_SR", benefit_type="16", water_item="SB_AGUA_COM")),
    ("R", dict(water_item=None, sewage_item="SB_ESGOTO_RES_D")),
]


def test_classification_covers_every_rule(spark):
    df = bills(spark, *[{**c, "contract": i} for i, (_, c) in enumerate(CLASSES)])
    got = {r.contract: r.category_code for r in facts.coded_bills(df).collect()}
    assert got == {i: code for i, (code, _) in enumerate(CLASSES)}
    used = {code for code, _ in CLASSES if code}
    from metermill.rules import CODE_RULES

    assert used == {r.code for r in CODE_RULES}


def _ref(spark, rows):
    return spark.createDataFrame(rows, "account string, category_detail string, region string, vol_median_ref double, vol_max_ref double, months_ref bigint")


def test_size_class_needs_share_volume_and_months(spark):
    p = replace(SizeParams(), thresholds=(("Industrial", 0.5, 10.0),))
    ref = _ref(spark, [
        ("a", "Industrial", "X", 50.0, 60.0, 6), ("b", "Industrial", "X", 50.0, 60.0, 5), ("c", "Comercial", "X", 99.0, 99.0, 12),
        ("d", "Industrial", None, 99.0, 99.0, 12), ("a", "Comercial", "X", 60.0, 60.0, 12),
    ])
    sized = accounts.agg_size(ref, accounts.agg_series_total(ref), accounts.thresholds(spark, p), p)
    got = {(r.account, r.category_detail): r.size_class for r in sized.collect()}
    assert got == {("a", "Industrial"): "Grande", ("b", "Industrial"): "Demais", ("c", "Comercial"): "Demais", ("a", "Comercial"): "Demais"}
    main = {r.account: r.category_detail for r in accounts.win_main_cat(sized).collect()}
    assert main["a"] == "Comercial"  # the larger median


def test_absurd_volumes_go_to_the_median(spark):
    rows = []
    for m in range(1, 10):
        rows.append(("a", m, 20.0))
        rows.append(("z", m, 0.0))
    rows += [("a", 10, 99990.0), ("z", 10, 60000.0), ("a", 11, 49999.0), ("-1", 1, 9e6)]
    f = spark.createDataFrame([(a, 2024, m, v, 0.0, 0.0, 0.0) for a, m, v in rows],
                              "account string, year int, month int, vol_meas_water double, vol_meas_sewage double, vol_bill_water double, vol_bill_sewage double")
    got = {(r.account, r.month): r.f_meas_water for r in accounts.agg_absurd_factor(f, AbsurdParams()).collect()}
    assert got == {("a", 10): pytest.approx(20 / 99990), ("z", 10): 0.0}


def test_territory_recode(spark):
    rows = [
        ("m1", "Residencial", "Residencial Normal", None), ("m1", "Residencial", "Residencial Social", "Rural"),
        ("m1", "Residencial", "Residencial Normal", "Informal"), ("m2", "Residencial", "Residencial Social Vulnerável", "Rural"),
        ("m2", "Residencial", "Residencial Normal", "Rural"), ("m2", "Comercial", "Comercial", "Rural"),
    ]
    df = spark.createDataFrame(rows, "municipality string, category string, category_detail string, territory string")
    got = {(r.municipality, r.category_detail, r.territory, r.territory_filled) for r in territory.prj_territory(df, BaseParams()).collect()}
    assert got == {
        ("m1", "Residencial Normal", "Urbano", True), ("m1", "Residencial Social", "Informal", False),
        ("m1", "Residencial Normal", "Informal", False), ("m2", "Residencial Social Vulnerável", "Urbano", False),
        ("m2", "Residencial Normal", "Rural", False), ("m2", "Comercial", "Total", False),
    }


def test_sentinels(spark):
    df = spark.createDataFrame([(x,) for x in (None, "", "null", "NULL", "0", " Urbano ", "00")], "territory string")
    assert [r.territory for r in territory.prj_sentinel(df).collect()] == [None] * 5 + ["Urbano", "00"]


@pytest.mark.parametrize("vols,classes", [((70, 20, 8, 2), "ABCC"), ((90, 10), "BC")])
def test_abc(spark, vols, classes):
    df = spark.createDataFrame([(f"m{i}", float(v)) for i, v in enumerate(vols)], "municipality string, vol double")
    got = {r.municipality: r.abc_class for r in territory.prj_abc(df, BaseParams()).collect()}
    assert "".join(got[f"m{i}"] for i in range(len(vols))) == classes


def test_validity_first_reason_wins(spark):
    last = date(2026, 8, 1)
    rows = [
        (1, date(2026, 6, 1), 50.0, 500.0), (2, date(2026, 5, 1), 5.0, 5.0), (3, last, 9.0, 500.0), (4, last, 10.0, 99.0), (5, last, 10.0, 100.0),
        (6, last, None, 500.0),
    ]
    df = spark.createDataFrame(rows, "id int, last_period date, mean_units double, mean_volume double").withColumn("base_last", F.lit(last))
    got = {r.id: r.reason for r in territory.prj_validity(df, BaseParams()).collect()}
    assert got == {1: None, 2: "encerrada", 3: "poucas economias", 4: "pouco volume", 5: None, 6: "poucas economias"}


def _stage1(spark, rows):
    cols = {c: 0.0 for c in [*territory.SUMS, "vol_meas_water_imputed"]}
    out = []
    for detail, period, vol, units in rows:
        d = dict(region="R", municipality="M", ibge_code="1", office=1, category="Residencial", category_detail=detail, territory="Urbano",
                 size_class="Demais", period=period, **cols)
        d.update(vol_meas_water=vol, vol_bill_water=vol, units_water=units)
        out.append(Row(**d))
    return spark.createDataFrame(out)


def test_rebalance_keeps_the_group_total(spark):
    rows = []
    for d, feb, mar, apr, may in (("A", 100.0, 10.0, 190.0, 100.0), ("B", 300.0, 50.0, 350.0, 300.0)):
        for p, v in zip((2, 3, 4, 5), (feb, mar, apr, may)):
            rows.append((d, date(2026, p, 1), v, float(10 * p)))
    rows += [("A", date(2025, 3, 1), 50.0, 1.0), ("A", date(2025, 4, 1), 50.0, 1.0)]  # history share .50
    rows += [("B", date(2025, 3, 1), 39.0, 1.0), ("B", date(2025, 4, 1), 61.0, 1.0)]  # .39 is out of range
    res = rebalance.rebalance(_stage1(spark, rows), BaseParams()).where("period >= '2026-03-01' and period < '2026-05-01'").collect()
    got = {(r.category_detail, r.period.month): r for r in res}
    total = sum(r.vol_meas_water for r in res)
    assert total == pytest.approx(600.0)
    assert got[("A", 3)].vol_meas_water == pytest.approx(150 * 0.5)  # 600 x 200 / 800
    assert got[("B", 3)].vol_meas_water == pytest.approx(450 * 0.505)
    assert got[("A", 3)].units_water == pytest.approx(20 + 30 / 3)
    assert got[("A", 4)].units_water == pytest.approx(20 + 30 * 2 / 3)
    assert all(r.rebalanced for r in res)


def test_rebalance_can_be_off(spark):
    df = _stage1(spark, [("A", date(2026, 3, 1), 10.0, 1.0)])
    assert rebalance.rebalance(df, replace(BaseParams(), window_start=None)).first().vol_meas_water == 10.0


def test_jobs_carry_inside_each_municipality(spark):
    keys = spark.createDataFrame([("1",), ("2",)], "ibge_code string")
    last = spark.createDataFrame([(date(2020, 4, 1),)], "last date")
    vals = spark.createDataFrame([("1", date(2020, 2, 1), 5.0)], "ibge_code string, period date, stock double")
    got = {(r.ibge_code, r.period.month): r.jobs for r in covariates.win_locf(covariates.jn_calendar(keys, last, vals, BaseParams())).collect()}
    assert got == {("1", 1): None, ("1", 2): 5.0, ("1", 3): 5.0, ("1", 4): 5.0, ("2", 1): None, ("2", 2): None, ("2", 3): None, ("2", 4): None}


def test_tariff(spark):
    p = replace(TariffParams(), base_month=date(2022, 1, 1), last_month=date(2022, 4, 1), details=("X", "Y"),
                adjustments=((date(2022, 3, 1), date(2022, 2, 1), None, 10.0), (date(2022, 3, 1), date(2022, 2, 1), "X", -50.0)))
    idx = spark.createDataFrame([(date(2022, m, 1), v) for m, v in ((1, 100.0), (2, 110.0), (3, 110.0))], "period date, index double")
    got = {(r.category_detail, r.period.month): r for r in covariates.agg_tariff(covariates.adjustments(spark, p), covariates.details(spark, p), idx, p).collect()}
    assert got[("X", 3)].real_tariff == pytest.approx(100 * 1.1 * 0.5 / 1.1)
    assert got[("Y", 2)].real_tariff == pytest.approx(100 / 1.1)
    assert got[("Y", 4)].estimated and got[("Y", 4)].real_tariff == pytest.approx(100.0)


def test_climate_coverage_uses_the_worst_variable(spark):
    rows = [("a", date(2024, 1, d), 20.0, 1.0) for d in range(1, 29)]  # 28 of 31
    rows += [("b", date(2024, 1, d), 20.0, 1.0) for d in range(1, 28)]  # 27
    rows += [("c", date(2024, 1, d), 20.0, 1.0 if d < 28 else None) for d in range(1, 32)]  # one variable short
    df = spark.createDataFrame(rows, "ibge_code string, day date, t double, r double")
    got = covariates.agg_climate_month(df, {"t": "temp_med", "r": "prec_tot"}, CovariateParams()).collect()
    assert [(r.ibge_code, r.valid_days) for r in got] == [("a", 28)]


def test_peaks_only_short_runs_that_return(spark):
    rows = []
    tests = {"one": [9, 1, 1, 1, 1], "three": [9, 9, 9, 1, 1], "four": [9, 9, 9, 9, 1], "last": [1, 1, 1, 1, 9]}
    for k, v in tests.items():
        rows += [(k, date(2025, m, 1), 1.0, 1.0) for m in range(1, 13)]
        rows += [(k, date(2026, m, 1), float(x), float(x)) for m, x in enumerate(v, 1)]
    df = spark.createDataFrame(rows, "series_key string, period date, vol double, vol_adj double")
    got = series.ts_peaks(df, date(2025, 12, 1), 3.0, 3).where("peak").groupBy("series_key").count().collect()
    assert {r[0]: r[1] for r in got} == {"one": 1, "three": 3}


def test_metrics_drop_zero_actuals(spark):
    df = spark.createDataFrame([("g", "s", "m", 100.0, 110.0, 10.0), ("g", "s", "m", 200.0, 180.0, 10.0), ("g", "s", "m", 0.0, 5.0, 1.0)],
                               "grouping string, scenario string, model string, vol_actual double, vol_fit double, units double")
    r = evaluate.acc_metrics(df, evaluate.CELL).first()
    assert (r.n, r.mape, r.wape, r.bias, r.mae, r.ape_max) == (2, 10.0, 10.0, pytest.approx(-10 / 3), 15.0, 10.0)
    assert r.rmse == pytest.approx((250) ** 0.5)
    assert r.rmse_consumption == pytest.approx(2.5**0.5)


def test_selection_prefers_no_drift_then_fewer_series(spark):
    rows = [("A", "c", "arima_2", 0.500), ("B", "c", "arima_2_sem_drift", 0.540), ("C", "c", "arima_2_sem_drift", 0.560), ("A", "c", "snaive", 0.1)]
    df = spark.createDataFrame(rows, "grouping string, category_detail string, model string, wape double")
    n = spark.createDataFrame([("A", 20), ("B", 40), ("C", 10)], "grouping string, n_series bigint")
    got = evaluate.win_tol_pick(df, n, ["category_detail"], "wape", 0.05).collect()
    assert [(r.grouping, r.model) for r in got] == [("B", "arima_2_sem_drift")]


def test_allocation_rules(spark):
    end = date(2026, 8, 1)
    keys = spark.createDataFrame([
        ("k1", "São João", "Residencial Normal", "Urbano", 30.0, end), ("k2", "São João", "Residencial Normal", "Informal", 10.0, end),
        ("k3", "Itu", "Residencial Normal", "Urbano", 5.0, end),
    ], "series_key string, municipality string, category_detail string, territory string, units double, period date")
    prem = spark.createDataFrame([("SAO JOAO", "NORMAL", "AGUA", 40.0), ("ITU", "RURAL", "A E", 7.0), ("NOWHERE", "NORMAL", "AGUA", 3.0), ("ITU", "NORMAL", "ESGOTO", 99.0)],
                                 "municipality_norm string, usage_norm string, type_norm string, increment double").withColumn("period", F.lit(date(2027, 1, 1)))
    inc = projection.premise_increments(prem, "med_agua")
    tgt = projection.premise_targets(inc, keys, projection.prj_usage_map(spark), end)
    alloc = projection.agg_alloc(inc, tgt)
    assert {r.series_key: (r.increment, r.rule) for r in alloc.collect()} == {"k1": (30.0, "de_para"), "k2": (10.0, "de_para"), "k3": (7.0, "municipio")}
    assert {r.rule: r.increment for r in projection.alloc_report(inc, alloc).collect()}["nao_alocado"] == 3.0

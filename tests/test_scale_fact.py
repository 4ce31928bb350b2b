"""The shuffle of bills by account, on rows built here."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from metermill.operators import facts
from metermill.plans import workspace as w
from metermill.rules import NO_ACCOUNT


@pytest.fixture
def clean(spark):
    rows = [
        (a, c, dt.date(2001, 1, 1), 2001, 1, 10, "0", "SB_NORMAL", k, "2", water, "-1", 1, 30, v)
        for a in ("1", "2", NO_ACCOUNT, None) for c, k, water, v in ((7, "SB_COM", "SB_AGUA_COM", 2), (8, "SB_IND", "SB_AGUA_IND", None), (9, None, "-1", 5))
    ]
    names = facts.BILL_COLUMNS[:14]
    kinds = {"contract": "long", "issue_date": "date", **dict.fromkeys(("year", "month", "office", "units", "days"), "int")}
    df = spark.createDataFrame(rows, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names) + ", v int")
    return df.select(*names, *[F.col("v").cast("decimal(18,7)").alias(c) for c in facts.BILL_COLUMNS[14:]])


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def test_bills_travel_with_their_category_and_without_their_codes(spark, clean):
    latest = spark.createDataFrame([("1", "Urbano"), (NO_ACCOUNT, "Rural")], "account string, territory string")
    fact = facts.fact_by_account(clean, latest)
    dealt = [n for n in nodes(fact._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "RepartitionByExpression"]
    assert len(dealt) == 1
    columns = {c.split("#")[0] for c in dealt[0].output().mkString(",").split(",")}
    assert {"account", "category_code", "item_code", "is_water", "is_sewage", "is_avail"} <= columns
    assert not columns & {"contract", "issue_date", "benefit_type", "product_code", "class_code", "usage_code", "water_item", "sewage_item"}
    want = facts.agg_account_month(facts.classified(clean), latest)
    assert sorted(map(str, fact.collect())) == sorted(map(str, want.collect()))
    assert len(want.collect()) == 12


def test_stages_with_long_rules_are_built_from_short_methods(spark, tmp_path):
    asked, seen = spark.conf.get(w.METHOD_KEY), {}

    def build(name):
        seen[name] = int(spark.conf.get(w.METHOD_KEY))
        return spark.range(3)

    ws = w.Workspace(spark, str(tmp_path))
    assert ws.stage("rules", lambda: build("rules"), long_rules=True).count() == 3
    ws.stage("plain", lambda: build("plain"))
    assert seen == {"rules": w.METHOD_BYTES, "plain": int(asked)}
    with pytest.raises(KeyError), w.short_methods(spark):
        raise KeyError
    assert spark.conf.get(w.METHOD_KEY) == asked

"""Shuffles of the stages that read whole tables, on rows built here."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from metermill.operators import accounts, facts
from metermill.plans import workspace as w
from metermill.rules import NO_ACCOUNT
from metermill.sources import driver_tables as src


@pytest.fixture
def joins_shuffle(spark):
    """No side is small enough for a broadcast, as with large tables."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.fixture
def tables(spark, tmp_path):
    day = dt.date(2001, 3, 4)
    made = {
        "lineitem": (
            [(k, p, 7, n, 3.0, 100.0, 0.05, "N", "O", day) for k in (1, 2, 3) for n, p in enumerate((50, 51), 1)],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
            "l_discount double, l_returnflag string, l_linestatus string, l_shipdate date",
        ),
        "orders": (
            [(1, 97, "O", day), (2, 102, "O", day), (3, 5, "P", day)],
            "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date",
        ),
        "customer": ([(97, 1, "BUILDING"), (102, 2, "HOUSEHOLD"), (5, 3, "BUILDING")], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "part": ([(50, "Brand#1", "SMALL"), (51, "Brand#2", "PROMO")], "p_partkey long, p_brand string, p_type string"),
    }
    for name, (rows, ddl) in made.items():
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_meet_in_the_place_of_the_last_join(spark, tables, joins_shuffle):
    clean = facts.prj_dedup(src.bills(spark, tables))
    assert plan(clean).count("hashpartitioning(") == 6  # two for each of three joins, none for the DISTINCT
    assert plan(clean).count("hashpartitioning(l_") == 2  # line items: by part, by order
    assert src.bills(spark, tables).where("processed = 'S'").count() == 6  # part 50 comes twice
    assert clean.count() == 4
    assert src.bill_rows(spark, tables) == 6


def bill(account, contract, month, water=2):
    return (account, contract, 2001, month, water)


def bills(spark, rows):
    df = spark.createDataFrame(rows, "account string, contract long, year int, month int, meas_water int")
    fixed = {c: F.lit("0").cast("decimal(18,7)") for c in facts.BILL_COLUMNS if c.startswith(("meas_", "bill_")) and c != "meas_water"}
    codes = {"benefit_type": "0", "product_code": "SB_NORMAL", "class_code": "SB_COM", "usage_code": "2", "water_item": "SB_AGUA_COM", "sewage_item": "-1"}
    return df.withColumns({
        **fixed, **{k: F.lit(v) for k, v in codes.items()}, "meas_water": F.col("meas_water").cast("decimal(18,7)"),
        "issue_date": F.lit(dt.date(2001, 1, 1)), "office": F.lit(10), "units": F.lit(1), "days": F.lit(30),
    }).select(*facts.BILL_COLUMNS)


def test_fact_by_account_is_the_fact(spark, joins_shuffle):
    rows = [bill(a, c, m) for a in ("1", "2", "3", NO_ACCOUNT, None) for c in (7, 8) for m in (1, 2)]
    latest = spark.createDataFrame([("1", "Urbano"), ("2", None), (NO_ACCOUNT, "Rural")], "account string, territory string")
    clean = bills(spark, rows)
    got, want = facts.fact_by_account(clean, latest), facts.agg_account_month(facts.classified(clean), latest)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert len(got.collect()) == 10
    # bills of real accounts are shuffled once, by account; the rest by all keys; the territory by account
    mine = plan(got).split("Union")[1]
    assert "hashpartitioning(account" in mine
    assert plan(facts.fact_by_account(clean.where(facts.has_account()), latest)).count("hashpartitioning(account") <= 4


def test_factor_join_keeps_the_fact_in_its_place(spark, joins_shuffle):
    fact = spark.createDataFrame(
        [("1", 2001, 1), ("1", 2001, 2), ("1", None, 2), ("2", 2001, 1), (NO_ACCOUNT, 2001, 1), (None, 2001, 1)],
        "account string, year int, month int",
    ).repartition(3, "account")
    factors = spark.createDataFrame(
        [("1", 2001, 1, 0.5, 0.25, 1.0, 1.0), ("1", 2001, 3, 0.1, 0.1, 0.1, 0.1), ("1", None, 2, 0.2, 0.2, 0.2, 0.2)],
        "account string, year int, month int, " + ", ".join(f"f_{v} double" for v in accounts.VOLUMES),
    )
    out = accounts.jn_factor(fact, factors)
    got = sorted(tuple(r[f"f_{v}"] for v in accounts.VOLUMES) for r in out.collect())
    assert got == sorted([(0.5, 0.25, 1.0, 1.0)] + [(1.0,) * 4] * 5)
    assert out.columns == ["account", "year", "month", *[f"f_{v}" for v in accounts.VOLUMES]]
    assert "hashpartitioning(account" in plan(out)
    assert not [x for x in plan(out).split("hashpartitioning(")[1:] if "year" in x.split(")")[0]]


def test_large_inputs_get_more_shuffle_tasks(spark):
    asked = spark.conf.get(w.PARTITIONS_KEY)
    with w.dealt(spark, 10 * w.ROWS_A_TASK + 1):
        assert spark.conf.get(w.PARTITIONS_KEY) == str(max(int(asked), 11))
    with w.dealt(spark, 0):
        assert spark.conf.get(w.PARTITIONS_KEY) == asked
    with pytest.raises(KeyError), w.dealt(spark, 10**9):
        raise KeyError
    assert spark.conf.get(w.PARTITIONS_KEY) == asked

"""The sums of orders behind climate and prices, on rows built here."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from catalog import stages as st
from metermill.plans.workspace import Workspace
from metermill.sources import driver_tables as src

THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


@pytest.fixture
def tables(spark, tmp_path):
    """Orders, customers and line items with repeated and null keys, and some without a match."""
    before = spark.conf.get(THRESHOLD)
    spark.conf.set(THRESHOLD, "-1")  # no side is small enough for a broadcast, as with large tables
    jan, feb = dt.datetime(2001, 1, 9), dt.datetime(2001, 2, 3)
    made = {
        "lineitem": (
            [(k, 50 + n, 7 + n, n, 3.0, 100.25, tax, 0.01 * n, "R", "O", dt.datetime(2001, 3, 4, 5)) for k in (1, 1, 2, 3, 4, 5, 9, None) for n, tax in enumerate((0.02, 0.07, None), 1)],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, "
            "l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
        ),
        "orders": (
            [(1, 10, "O", jan), (2, 11, "O", feb), (2, 11, "O", feb), (3, 12, "O", jan), (4, 99, "O", feb), (5, None, "O", None), (6, 10, "O", jan)],
            "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp",
        ),
        "customer": ([(10, 1, "BUILDING"), (10, 2, "HOUSEHOLD"), (11, 1, "BUILDING"), (12, None, "BUILDING"), (None, 4, "BUILDING")], "c_custkey long, c_nationkey int, c_mktsegment string"),
    }
    for name, (rows, ddl) in made.items():
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    yield str(tmp_path)
    spark.conf.set(THRESHOLD, before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


def test_climate_and_prices_are_those_of_single_line_items(spark, tables):
    li, o, c = (src.read(spark, tables, t) for t in ("lineitem", "orders", "customer"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("period", F.to_date(F.trunc("o_orderdate", "month")))
    tax, disc = (F.sum(F.col(x).cast("decimal(4,2)")).cast("double") / F.count("*") for x in ("l_tax", "l_discount"))
    climate = j.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "period").agg(
        F.round(20 + 10 * disc, 6).alias("t"), F.round(0.1 + 100 * tax, 6).alias("p")
    ).select((350000 + F.col("c_nationkey")).cast("string"), "period", "t", "p")
    prices = j.groupBy("period").agg(F.round(20 * disc - 0.5, 2).alias("value"))
    months = src.order_months(spark, tables)
    values = [tuple(r) for r in src.climate_monthly(months).collect()]
    assert sorted(map(str, values)) == sorted(str(tuple(r)) for r in climate.collect())
    assert {v[0] for v in values} == {"350001", "350002", None}
    assert rows(src.price_index_monthly(months)) == rows(prices)
    assert prices.count() == 3


def test_line_items_are_summed_before_their_shuffle_and_read_once(spark, tables):
    text = plan(src.order_months(spark, tables))
    assert text.count("FileScan parquet [l_orderkey") == 1
    assert "partial_sum" in text.split("Exchange hashpartitioning(l_orderkey")[1].split("FileScan")[0]
    ws = Workspace(spark, tables)
    made = [plan(stage(ws)) for stage in (st.climate, st.price_index)]
    assert ws.has("order_months")
    assert not [p for p in made if "l_orderkey" in p]

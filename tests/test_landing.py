"""One CSV file from ranges, and the two layouts of an external forecast."""

import csv
import os
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from metermill.sources import landing, sinks
from metermill.sources.files import Files


def test_one_ordered_csv_with_one_header(spark, tmp_path):
    rows = [(f"k{i % 97:02d}", i, date(2020, 1 + i % 12, 1), Decimal(i), None if i % 7 else 'say "x", or\ny') for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, n int, period date, d decimal(10,2), `odd, name` string").repartition(16)
    path = sinks.snk_csv(df, f"{tmp_path}/out", ["k", "n"])
    assert path.endswith("base_202001-202012.csv") and os.path.isfile(path)
    assert sorted(f for f in os.listdir(f"{tmp_path}/out") if not f.startswith(".")) == ["base_202001-202012.csv"]
    with open(path, newline="") as f:
        got = list(csv.reader(f, escapechar="\\", doublequote=False))
    assert got[0] == ["k", "n", "period", "d", "odd, name"] and got[0] not in got[1:] and len(got) == 5001
    assert [(r[0], int(r[1])) for r in got[1:]] == sorted((r[0], r[1]) for r in rows)
    assert got[1][3] == "0.0"  # decimals are written as doubles
    again = sinks.snk_csv(df.where("n < 10"), f"{tmp_path}/out", ["k", "n"])  # written over
    assert again.endswith("base_202001-202010.csv")
    back = spark.read.option("header", True).option("multiLine", True).csv(path)
    assert back.count() == 5000 and back.columns == df.columns


def test_csv_without_rows_has_its_header(spark, tmp_path):
    path = sinks.snk_csv(spark.createDataFrame([], "k string, period date"), f"{tmp_path}/none", ["k"])
    with open(path) as f:
        assert f.read() == "k,period\n"
    assert path.endswith("/base.csv")


def test_joined_bytes_are_the_parts(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    parts = [f"p{i}" for i in range(3)]
    for i, p in enumerate(parts):
        assert files.create(p, f"line {i}\n" * 100_000) and not files.create(p, "x")
    files.join(parts, "all", "head\n")
    assert files.text("all") == "head\n" + "".join(f"line {i}\n" * 100_000 for i in range(3))


RAW = [
    ("PROJ", "202401", "A", "R1", "vol_med_agua", "10"), ("PROJ", "202401", "A", "R1", "econ_agua", "2"), ("PROJ", "202401", "A", "R1", "vol_med_agua", "5"),
    ("PROJ", "202401", "A", "R1", "econ_agua", "1"), ("REAL", "202312", "A", "R1", "vol_med_agua", "9"), ("REAL", "202312", "A", "R1", "econ_agua", "2"),
    ("PROJ", "202402", "A", "R2", "vol_med_agua", None), ("PROJ", "202402", "A", "R2", "econ_agua", "4"),
]
PAIRED = [("2024-01-15", "R1", "A", "2", "10", "PROJ"), ("2024-01-01T00:00:00", "R1", "A", "1", "5", "PROJ"), ("2023-12-01", "R1", "A", "2", "9", "REAL"), ("202402", "R2", "A", "4", None, "PROJ")]


def forecast(df):
    return sorted((r.period, r.ext_region, r.ext_category, r.vol, r.units) for r in landing.src_extforecast(df).collect())


def test_layouts_of_the_external_forecast_agree(spark):
    raw = spark.createDataFrame(RAW, "tp string, periodo string, categoria string, regiao string, var string, valor string")
    paired = spark.createDataFrame(PAIRED, "periodo string, cd_regiao_adj string, categoria_detalhe string, N_Economias string, ` vol_med` string, TP string")
    want = [(date(2024, 1, 1), "R1", "A", 15.0, 3.0), (date(2024, 2, 1), "R2", "A", None, 4.0)]
    assert forecast(raw) == forecast(paired) == want
    assert len(forecast(paired.drop("TP"))) == 3  # nothing is marked: every row counts
    assert len(forecast(raw.where("tp = 'REAL'"))) == 1


def test_several_pairs_of_columns_become_rows(spark):
    blocks = spark.createDataFrame(
        [("202401", "R1", "A", "10", "2", "5", "1")], "periodo string, regiao string, categoria string, vol_med string, n_economias string, vol_med_2 string, n_economias_2 string"
    )
    assert forecast(blocks) == [(date(2024, 1, 1), "R1", "A", 15.0, 3.0)]


def test_unknown_layout_is_an_error(spark):
    with pytest.raises(ValueError):
        landing.src_extforecast(spark.createDataFrame([("202401", "1")], "periodo string, x string").withColumn("y", F.lit(1)))

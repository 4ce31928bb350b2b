"""Window patterns against brute force, with a hot key."""

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from metermill.functions import dates, numeric, text, windows


def test_running_share_equals_one_big_window(spark):
    rng = random.Random(1)
    rows = [(f"m{i:04d}", float(rng.choice([1, 2, 3, rng.random() * 100]))) for i in range(3000)]
    df = spark.createDataFrame(rows, "name string, v double")
    got = {r.name: r.s for r in windows.running_share(df, "v", "name", "s").collect()}
    order = sorted(rows, key=lambda x: (-x[1], x[0]))
    total, run = sum(v for _, v in rows), 0.0
    for name, v in order:
        run += v
        assert got[name] == pytest.approx(run / total, rel=1e-9)


def test_rank_by_cells_equals_row_number(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(20)}", rng.randrange(5), i) for i in range(4000)]
    rows += [(None, 1, -1), (None, 0, -2)]
    df = spark.createDataFrame(rows, "k string, c int, t int")
    got = windows.rank_by_cells(df, ["k"], [F.col("c")], [F.col("t")], "rn").collect()
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        want = sorted((c, t) for k, c, t in rows if k == key)
        mine = [(r.c, r.t) for r in sorted((x for x in got if x.k == key), key=lambda x: x.rn)]
        assert mine == want


def test_interpolate_inside_and_outside(spark):
    vals = {3: 10.0, 6: 40.0}
    df = spark.createDataFrame([("a", date(2020, m, 1), vals.get(m)) for m in range(1, 9)], "k string, period date, x double")
    got = {r.period.month: r.x for r in windows.interpolate_months(df, ["k"], ["x"]).collect()}
    assert got == {1: 10.0, 2: 10.0, 3: 10.0, 4: pytest.approx(20.0), 5: pytest.approx(30.0), 6: 40.0, 7: 40.0, 8: 40.0}


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    data = {"hot": np.round(rng.normal(size=6000), 2), "one": np.array([4.0]), "few": rng.random(7)}
    df = spark.createDataFrame([(k, float(v)) for k, a in data.items() for v in a] + [("few", None)], "k string, v double")
    got = {r.k: r for r in numeric.exact_quantiles(df, ["k"], "v", {"q1": 0.25, "m": 0.5, "q9": 0.9}).collect()}
    for k, a in data.items():
        for name, p in (("q1", 0.25), ("m", 0.5), ("q9", 0.9)):
            assert got[k][name] == pytest.approx(np.quantile(a, p), abs=1e-12), (k, name)


def test_text_and_dates(spark):
    df = spark.createDataFrame([(" São  João-d'Oeste ", "mai/27", "202608"), ("x", "Total", "2026-08-15")], "a string, b string, c string")
    r = df.select(text.normalise_name("a"), dates.parse_pt_month("b"), dates.parse_period("c"), dates.folder_month(F.lit("pasta 2026-08"))).collect()
    assert tuple(r[0]) == ("SAO JOAO D OESTE", date(2027, 5, 1), date(2026, 8, 1), date(2026, 8, 1))
    assert tuple(r[1]) == ("X", None, date(2026, 8, 1), date(2026, 8, 1))


def test_snap_round(spark):
    df = spark.createDataFrame([(1.005,), (1.0049999999999999,), (float("nan"),), (float("inf"),)], "x double")
    assert [r[0] for r in df.select(numeric.snap_round("x", 2)).collect()] == [1.01, 1.01, None, None]

"""Cleaning of series with injected outliers, and signatures of training sets."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from metermill.operators import fit, series
from metermill.operators.series import GROUPED


def month(i):
    return date(2017 + i // 12, i % 12 + 1, 1)


def smooth(n=60, season=0.15, noise=0.01):
    """A trend, a season, and a remainder that repeats with a period the season does not have."""
    return [20 * math.exp(0.004 * i + season * math.sin(2 * math.pi * i / 12) + noise * math.sin(2.399 * i * i)) for i in range(n)]


def cleaned(spark, columns):
    rows = [(k, month(i), v) for k, values in columns.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, period date, v double")
    got = series.ts_clean(df, "k", "v", "c", F.lit(True), True).collect()
    out = {k: [None] * len(v) for k, v in columns.items()}
    for r in got:
        out[r.k][(r.period.year - 2017) * 12 + r.period.month - 1] = r.c
    return out


CLUSTERS = {
    "single": {20: 8.0}, "pair": {20: 6.0, 21: 6.0}, "three": {30: 5.0, 31: 7.0, 32: 6.0}, "low three": {30: 0.1, 31: 0.15, 32: 0.1}, "both ways": {25: 7.0, 26: 0.1, 40: 5.0, 41: 5.0},
    "at the start": {0: 6.0, 1: 6.0}, "at the end": {58: 6.0, 59: 7.0}, "two clusters of three": {14: 5.0, 15: 5.0, 16: 5.0, 44: 0.2, 45: 0.2, 46: 0.2},
}


def test_clusters_of_outliers_leave_their_neighbours_alone(spark):
    plain = smooth()
    columns = {name: [v * hit.get(i, 1.0) for i, v in enumerate(plain)] for name, hit in CLUSTERS.items()}
    got = cleaned(spark, {**columns, "none": plain})
    assert got["none"] == pytest.approx(plain)
    for name, hit in CLUSTERS.items():
        for i, v in enumerate(plain):
            if i in hit:
                assert got[name][i] == pytest.approx(v, rel=0.12), (name, i)
            else:
                assert got[name][i] == columns[name][i], (name, i)


def test_cleaning_of_short_flat_and_broken_series(spark):
    got = cleaned(spark, {
        "few": [1.0, None, -5.0, 2.0, 3.0], "flat": [5.0] * 20 + [500.0] + [5.0] * 20, "zeros": [4.0, 0.0, 4.0, None, 4.0, 4.0, 4.0], "nothing": [None, 0.0, -1.0], "level": [10.0] * 20 + [30.0] * 20,
    })
    assert got["few"] == [1.0, None, None, 2.0, 3.0] and got["nothing"] == [None] * 3
    assert got["flat"] == pytest.approx([5.0] * 41) and got["zeros"] == pytest.approx([4.0] * 7)
    assert got["level"] == pytest.approx([10.0] * 20 + [30.0] * 20)


SCHEMA = ", ".join(f"`{c}` string" for c in GROUPED) + ", period date, consumption double, units int"


def training(values):
    return [("g", "r", k, "c", "t", month(i), v, 7) for k, vs in values.items() for i, v in enumerate(vs) if v is not None]


def prints(spark, values, formulas=None, rows=None):
    df = spark.createDataFrame(rows or training(values), SCHEMA)
    return series.ts_fingerprint(df.repartition(5), formulas or {"m": "y ~ x"})


def test_fingerprint_sees_what_a_sum_cannot(spark):
    base = {"a": [1.0, 2.0, 3.0], "b": [4.0, 5.0, 6.0], "c": [1.0, 1.0, 1.0]}
    stored = prints(spark, base)
    assert fit.refit_due(stored, prints(spark, base)).count() == 0

    def due(values, **more):
        return sorted((r.group, r.reason) for r in fit.refit_due(stored, prints(spark, values, **more)).collect())

    assert due({**base, "a": base["b"], "b": base["a"]}) == [("a", "data"), ("b", "data")]  # two series swapped
    assert due({**base, "a": [1.0, -2.0, 3.0]}) == [("a", "data")]  # a sign
    assert due({**base, "b": [5.0, 4.0, 6.0]}) == [("b", "data")]  # a value moved by a month
    assert due({**base, "c": [1.0, 1.0]}) == [("c", "data")]
    assert due({k: v for k, v in base.items() if k != "b"} | {"d": [9.0]}) == [("b", "gone"), ("d", "new")]
    assert due(base, formulas={"m": "y ~ z"}) == [("a", "models"), ("b", "models"), ("c", "models")]
    twice = training(base) + training({"c": base["c"]}) * 2
    assert due(None, rows=twice) == [("c", "data")]  # rows that come three times: the exclusive or alone would not see it


def test_fingerprints_merge_upward(spark):
    import hashlib

    base = {"a": [1.0, 2.25, 3.0], "b": [4.0, None, 6.0]}
    rows = training(base)
    one = series.merge_fingerprints(prints(spark, base), []).first()
    hashes = []
    for r in rows:
        cells = [*map(str, r[:6]), f"{r[6]:.4f}", str(r[7])]
        digest = hashlib.md5("\x1f".join(cells).encode()).hexdigest()
        hashes.append((int(digest[:15], 16), int(digest[15:30], 16)))
    xor = [0, 0]
    for h in hashes:
        xor = [x ^ y for x, y in zip(xor, h)]
    assert (one.n_series, one.n_rows, one.xor_a, one.xor_b) == (2, 5, *xor)
    assert (one.sum_a, one.sum_b) == tuple(sum(h[i] for h in hashes) % series.MODULUS for i in (0, 1))
    assert series.merge_fingerprints(prints(spark, base).limit(0), []).first().n_rows == 0

"""Jacobi-Davidson against dense eigenvectors; the query against a plain whitening; odd rows."""

import math

import numpy as np
import pytest

from metermill.llm import whitening

SF = "/root/testdata/sf0.01"


def dense(rows):
    """What the contract says, in plain NumPy and Python integers."""
    keep = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in keep})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    c = np.array([[n * x[j] - sums[j] for j in range(d)] for x in fit], float) / n
    cov = c.T @ c / n
    e, q = np.linalg.eigh(cov)
    return keep, n, sums, e[::-1], q[:, ::-1], cov.trace()


def compare(got, rows, top=4):
    keep, n, sums, e, q, trace = dense(rows)
    k = min(top, len(e))
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == k * len(keep)
    x = np.array([v for _, v in keep], float)
    y = ((n * x - np.array(sums, float)) / n) @ q[:, :k] / np.sqrt(e[:k])
    mine = np.array([[by_id[i][j + 1].whitened for j in range(k)] for i, _ in keep])
    sign = np.sign((mine * y).sum(axis=0))
    assert np.abs(mine * sign - y).max() < 1e-8
    for i, v in keep:
        for j in range(k):
            r = by_id[i][j + 1]
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(v, sums))
            assert r.explained == pytest.approx(e[j] / trace, rel=1e-10)
            assert r.identity_error < 1e-10 and r.residual <= whitening.TOLERANCE


def test_query_equals_plain_whitening(spark):
    from __spark_entry__ import queries

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    df = queries()["op11_whitening"](spark, SF)
    assert df.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(df.collect(), rows)


SCHEMA = "vec_id long, embedding array<double>, x string, wh_id int, component string"


def whitened(spark, rows):
    return whitening.whiten(spark.createDataFrame([(i, v, "x", 1, "c") for i, v in rows], SCHEMA)).collect()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25, 0.1]), (2, [0.5, -0.25, 0.1]), (3, [-0.0, 1.0, 2.0]), (4, [0.3, 0.3, -0.9]), (5, None), (6, [nan, 0.0, 0.0]), (7, [0.0, None, 1.0]), (8, [inf, 0.0, 0.0]), (9, [0.9, -2.0, 0.4]), (10, [-1e-9, 0.001, 0.0])]
    compare(whitened(spark, rows), rows)
    odd = [*rows, (11, [1.0, 2.0]), (12, [])]
    compare(whitened(spark, odd), rows)
    again = whitened(spark, [*rows, (None, [0.5, 0.5, 0.5]), (1, [0.5, -0.25, 0.1])])
    assert sum(r.vec_id is None for r in again) == 3 and sum(r.vec_id == 1 for r in again) == 6


def test_empty_equal_and_flat_vectors(spark):
    assert whitened(spark, []) == []
    assert whitened(spark, [(1, None), (2, [])]) == []
    assert whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    flat = whitened(spark, [(i, [i * 1.0, i * 2.0, 5.0]) for i in range(5)])
    assert {r.component for r in flat} == {1} and all(r.explained == pytest.approx(1) for r in flat)


def test_sums_and_deviations_beyond_a_long(spark):
    """Python integers take over: deviations are exact as long as they fit and null beyond."""
    rows = [(1, [2.0**40, 1.0]), (2, [-(2.0**40), 3.0]), (3, [1e300, 0.0]), (4, [0.0, 9.0])]
    got = whitened(spark, rows)
    assert {r.deviation for r in got} == {None} and all(math.isfinite(r.whitened) for r in got)
    mild = [(i, [2.0**20 + i / 256, float(i * i)]) for i in range(6)]
    compare(whitened(spark, mild), mild)


@pytest.mark.parametrize("spectrum", [
    np.arange(1.0, 121), np.r_[np.full(5, 7.0), np.ones(40)], np.r_[1e9, 1.0, 1e-6, np.zeros(20)], np.r_[[1.0001, 1, 0.9999, 0.9998, 0.9997], np.linspace(0, 0.999, 150)], [3.0], [2.0, 1.0],
])
def test_solver_against_dense_matrices(spectrum):
    spectrum = np.sort(np.array(spectrum))[::-1]
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((len(spectrum), len(spectrum))))
    m = (q * spectrum) @ q.T
    m = (m + m.T) / 2
    e, v, r = whitening.eigenpairs(lambda w: m @ w, len(m), 4)
    k = min(4, len(m))
    assert np.abs(e - spectrum[:k]).max() <= 1e-13 * spectrum[0]
    assert np.abs(m @ v - v * e).max() <= 1e-13 * spectrum[0] and np.abs(v.T @ v - np.eye(k)).max() < 1e-13
    assert (r <= whitening.TOLERANCE * spectrum[0]).all()


def test_data_are_seen_through_products_only(spark):
    """No d x d covariance: a product with k columns returns d x k numbers, and k stays at the wanted pairs."""
    widths = []
    m = np.diag(np.arange(1.0, 65))

    def product(w):
        widths.append(w.shape[1])
        return m @ w

    whitening.eigenpairs(product, 64, 4)
    assert max(widths) <= 8

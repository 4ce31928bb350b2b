"""The backoff automaton against a plain model over dictionaries; probabilities of a state sum to one."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from metermill.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)})) + [None]


def plain(rows):
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    uni, bi = collections.Counter(), collections.Counter()
    for i, t in rows:
        if not held(i):
            w = tokens(t)
            uni.update(w)
            bi.update(zip([None] + w, w))
    n, v = sum(uni.values()), len(uni)
    p0 = lambda w: (uni[w] + 1) / (n + v + 1)
    by = collections.defaultdict(list)
    for (u, w), c in bi.items():
        by[int(math.log2(uni[u]))].append((c, (c - 1) / max(uni[u] - 1, 1) / (uni[w] / (n + v))))
    best = {}
    for b, cells in by.items():
        # the histogram's resolution, then the best point of a fine grid
        c = np.array([x for x, _ in cells], float)
        r = np.array([0.0 if y == 0 else 2 ** (lm.LOW + (min(max(math.floor((math.log2(y) - lm.LOW) * lm.STEP), 0), lm.BINS - 2) + 0.5) / lm.STEP) for _, y in cells])
        lo, hi = 0.0, 1.0
        for _ in range(60):
            a, z = lo + (hi - lo) / 3, hi - (hi - lo) / 3
            f = [(c * np.log(np.maximum(1 - x + x * r, 1e-300))).sum() for x in (a, z)]
            lo, hi = (a, hi) if f[0] < f[1] else (lo, z)
        best[b] = min((lo + hi) / 2, 0.999)

    def p(u, w):
        if not uni[u]:
            return p0(w)
        x = best[int(math.log2(uni[u]))]
        return x * bi[u, w] / uni[u] + (1 - x) * p0(w)

    out = {}
    for i, t in rows:
        w = tokens(t)
        out[i] = (held(i), len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10(p0(x)) for x in w), sum(math.log10(p(u, x)) for u, x in zip([None] + w, w)))
    return out, p, list(uni)


def compare(spark, rows, **settings):
    want, p, vocabulary = plain(rows)
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), **settings).collect()
    assert len(got) == len(rows)
    for r in got:
        x = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == x[:4]
        assert r.base_score == pytest.approx(x[4], rel=1e-9) and r.score == pytest.approx(x[5], rel=1e-6)
    return got, p, vocabulary


def test_small_table_equals_plain_model(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got, p, vocabulary = compare(spark, rows)
    for u in (None, vocabulary[1], vocabulary[-1], "never seen"):
        assert sum(p(u, w) for w in vocabulary) + p(u, "never seen") == pytest.approx(1)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_many_chunks_and_parts_give_the_same(spark, monkeypatch):
    rows = [(i, f"a b c{i % 7} d e{i % 3} " * (1 + i % 5)) for i in range(200)]
    one = {r.doc_id: r.score for r in compare(spark, rows)[0]}
    monkeypatch.setattr(lm, "KEYS", 40)
    many = {r.doc_id: r.score for r in compare(spark, rows, chunk_bytes=300)[0]}
    assert many == pytest.approx(one)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (2, " \n "), (None, "a A a"), (16, "x " * 70000)]])
def test_odd_tables(spark, rows):
    compare(spark, rows)

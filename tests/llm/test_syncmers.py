"""Fingerprints against plain definitions."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from metermill.llm import syncmers as sy


def plain_anchors(raw: bytes):
    def smer(x):
        h = 0
        for b in x:
            h = (h * 0x01000193 + b) & 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x2C1B3C6D & 0xFFFFFFFF
        h ^= h >> 12
        return h * 0x297A2D39 & 0xFFFFFFFF

    out = []
    for i in range(len(raw) - sy.K + 1):
        inner = [smer(raw[i + j : i + j + sy.S]) for j in range(sy.W)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


def test_anchors_equal_definition_and_are_context_free(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    df = spark.createDataFrame(texts + [(-1, None), (-2, "short")], "doc_id long, text string")
    got = {}
    for r in sy.anchors(df).collect():
        got.setdefault(r.doc_id, {})[r.pos] = r.hash
    by_kmer = {}
    for i, t in texts:
        raw = t.encode()
        assert sorted(got.get(i, {})) == plain_anchors(raw)
        for pos, h in got.get(i, {}).items():
            assert by_kmer.setdefault(raw[pos : pos + sy.K], h) == h
    assert -1 not in got and -2 not in got


def test_sketches_keep_the_smallest():
    rng = np.random.default_rng(1)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in (0, 3, 13, 40, 500, 4000, 60000)] + ["ab" * 50000, "é" * 30]
    data, offs = sy.flat(pa.array(texts))
    of, _, key = sy.anchor_hashes(data, offs)
    for i, s in enumerate(sy.sketches(pa.array(texts))):
        want = np.unique((key[of == i] >> np.uint64(32)).astype(np.uint32))[: sy.KEPT]
        if len(want):
            assert s.tolist() == want.tolist()
        else:
            assert len(s) == bool(texts[i])


def test_likeness():
    a, b = np.arange(0, 64, dtype=np.uint32), np.arange(32, 96, dtype=np.uint32)
    assert sy.likeness(a, a) == 1 and sy.likeness(a, b) == 32 / 64 and sy.likeness(a, a[:0]) == 0 and sy.likeness(a[:0], a[:0]) == 1


@pytest.mark.parametrize("block", [3, 2000])
def test_compare_equals_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(sy, "BLOCK", block)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(-5, ""), (-6, ""), (-7, None), (None, "tail é 漢字 of the table"), (10**12, "x" * 700000)]
    got = {r.doc_id: r for r in sy.compare(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0], reverse=True)
    prints = {}
    for (i, t), (j, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        h = len(t) // 2
        e = t[: len(t) - h] + after[:h]
        s, se, sn = sy.sketches(pa.array([t, e, after]))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), sy.written(s), sy.written(se))
        assert (r.near_edited, r.near_next) == (sy.likeness(s, se), sy.likeness(s, sn))
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint


@pytest.mark.parametrize("rows", [[], [(4, "only one")], [(4, None), (4, "b"), (4, "a"), (4, "a")]])
def test_odd_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(sy.compare(df).collect()) == len(rows)
    assert [r.sy_fingerprint for r in sy.fingerprints(df).collect() if not r.text] == ["" for _, t in rows if not t]

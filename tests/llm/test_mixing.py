"""Targets against a plain water filling, and what the mix takes."""

import random
import re

import pytest

from metermill.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """By source in order (None last): shares of 150 % by weight, stopped at twice the size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def check(spark, rows, near=0.02):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size string")
    got = mixing.rates(df).collect()
    assert len(got) == len(rows)
    size = lambda t: len(WORD.findall(t or ""))
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = plain_targets(sizes)
    source = {i: s for i, _, s, _ in rows}
    taken, least = dict.fromkeys(sizes, 0), {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        assert r.size == 0 or r.taken % r.size == 0
        taken[s] += r.taken
        if r.size:
            least[s] = min(least.get(s, 1 << 60), r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(near * want[s], least.get(s, 0))
    assert sorted(map(str, mixing.rates(df).collect())) == sorted(map(str, got))
    return df, got


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, None if r.source == "src3" else r.source, "x") for r in docs.collect()]
    df, got = check(spark, rows)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    often = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert often == {r.doc_id: r.copies for r in got if r.copies}


def test_hot_source_of_equal_sizes_and_long_documents(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 16)
    rng = random.Random(3)
    rows = [(i, "a b c d e", "hot", None) for i in range(900)] + [(1000 + i, "w " * rng.randrange(1, 400), f"s{i % 6}", None) for i in range(600)]
    rows.append((5000, "w " * 9000, "s1", None))
    check(spark, rows)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None), (2, "", "a", None)], [(1, "a b", "s", "1"), (1, "a b", "s", "1"), (None, "c", None, None)], [(3, "a", "s", None)]])
def test_odd_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size string")
    got = mixing.rates(df).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert mixing.mix(df).columns == df.columns

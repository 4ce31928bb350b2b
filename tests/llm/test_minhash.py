"""Near duplicates against all pairs on small tables."""

import random
import re

import pytest

from metermill.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def plain(rows, k):
    """Components by all pairs."""
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in where.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        n = len(sets[a] & sets[b])
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def check(spark, rows, k=4):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, shingle=k).collect()}
    assert got == plain(rows, k)


def test_stars_chains_and_borderline_copies(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, i = [], 0
    for n, edits, copies in ((60, 1, 30), (60, 2, 40), (200, 6, 30), (200, 9, 30), (12, 1, 20), (6, 1, 5)):
        base = [word() for _ in range(n)]
        last = base
        for c in range(copies):
            t = list(base if c % 2 else last)  # copies of the first text, and chains of copies of copies
            for _ in range(rng.randrange(edits + 1)):
                t[rng.randrange(n)] = word()
            last = t
            rows.append((i * 7919 % 100003, " ".join(t)))
            i += 1
    check(spark, rows)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(spark, rows)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a B"), (6, "a b c d"), (7, "x " * 50000), (8, "x  x x x x")]])
def test_odd_tables(spark, rows):
    check(spark, rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, u int")
    assert minhash.dedup(df, shingle=4).columns == ["doc_id", "text", "u"]


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (2, "a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [("2", "2", True), ("3", "2", False), ("3", "2", False), ("None", "None", True), ("None", "None", True)]
    assert sorted(str(r.doc_id) for r in minhash.dedup(df).collect()) == ["2", "None", "None"]

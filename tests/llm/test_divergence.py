"""The audit against its statement in DuckDB, and on small tables of odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from metermill.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, value string, rank int, part string"
ODD = [
    (1, "Ab ab AB. cd", "en", "s1", "x", 1, "p"), (2, "ab cd! ef", "en", "s2", None, 2, "p"), (3, "AB é É ef cd", "en", "s1", "x", 1, "p"), (3, "AB é É ef cd", "en", "s1", "x", 1, "p"),
    (4, None, "en", None, None, None, None), (5, "", "en", "s3", "", 0, ""), (6, "12 34 ,.;", "en", "s4", "", 0, ""), (7, "ab", None, "s1", "", 0, ""), (None, "ab ab", None, None, "", 0, ""),
    (8, "日本 ab\x00cd", None, "s2", "", 0, ""), (9, "solo solo", "de", "only", "", 0, ""), (10, "w " * 50_000 + "ab", "en", "s2", "", 0, ""), (11, "ab w", "en", "s5", "", 0, ""),
    (12, "w é", "en", "s5", "", 0, ""),
]


def statement(rows, schema=SCHEMA):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    if rows:
        con.executemany("insert into documents values (?, ?, ?, ?)", [list(r[:4]) for r in rows])
    return sorted(con.execute(divergence.ORACLE).fetchall(), key=str)


def audited(spark, rows):
    df = divergence.audit(spark.createDataFrame(rows, SCHEMA))
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_odd_rows_equal_the_statement(spark):
    got = audited(spark, ODD)
    assert got == statement(ODD)
    assert ("de", "only", "pair") not in {r[:3] for r in got}
    assert {(r[0], r[1]) for r in got if r[2] == "pair"} >= {("en", ""), ("en", "s3"), ("en", "s4"), ("", ""), ("", "s1")}
    assert all(r[4] == 0 for r in got if r[0] == "" and r[2] == "pair" and "s2" not in r)


def test_empty_table(spark):
    assert audited(spark, []) == statement([]) == []


def test_one_value_with_more_terms_than_ranks(spark):
    """600 terms of one cell: the first 200 in UTF-8 order stay, those beyond ASCII after those inside."""
    words = [f"a{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(590)] + ["é" + "abcdefghij"[i] for i in range(10)]
    rows = [(i, " ".join(words), "en", "s1", "", 0, "") for i in range(3)] + [(9, "other", "en", "s2", "", 0, "")]
    got = audited(spark, rows)
    assert got == statement(rows)


@pytest.mark.parametrize("cells", [4, 1 << 20])
def test_blocks_of_the_matrix_do_not_matter(spark, monkeypatch, cells):
    sums = divergence._Sums("en")
    for s, total in (("a", 10), ("b", 7), ("c", 0)):
        sums.group(s, total, 3)
    monkeypatch.setattr(divergence, "CELLS", cells)
    import numpy as np
    import pyarrow as pa

    rows = [("t1", "a", 4), ("t1", "b", 7), ("t2", "a", 5), ("t3", "a", 1)]
    for r in rows:  # one row a call: terms go on over calls
        sums.rows(pa.array([r[0]]), pa.array([r[1]]), np.array([r[2]]))
    got = {(x["source"], x["item"]): x["value"] for b in sums.result(False) for x in b.to_pylist()}
    counts = {"a": [4, 5, 1], "b": [7, 0, 0], "c": [0, 0, 0]}
    share = {s: [1 + 10**9 * (c + 1) // (t + 3) for c in counts[s]] for s, t in (("a", 10), ("b", 7), ("c", 0))}
    assert got == {(x, y): sum((p - q) ** 2 // q for p, q in zip(share[x], share[y])) for x in share for y in share if x != y}


def test_long_division_is_exact_for_large_counts():
    import numpy as np

    sums = divergence._Sums("x")
    for s, total in (("a", 8 * 10**15), ("b", 123_456_789_012_345)):
        sums.group(s, total, 1_000_003)
    sums.start()
    counts = np.array([[7 * 10**15 + 12_345, 99_999_999_999_999], [0, 1], [8 * 10**15, 123_456_789_012_345]], np.int64)
    want = [[1 + 10**9 * (int(c) + 1) // (t + 1_000_003) for c, t in zip(row, (8 * 10**15, 123_456_789_012_345))] for row in counts]
    assert sums.shares(counts).tolist() == want


def test_shares_in_spark_are_exact_for_large_counts(spark):
    rows = [(7 * 10**15 + 12_345, 8 * 10**15, 1_000_003), (0, 0, 1), (9 * 10**12, 10**13, 5)]
    df = spark.createDataFrame(rows, "n long, total long, terms long").select(divergence.share("n", "total").alias("p"), F.lit(1))
    assert [r.p for r in df.collect()] == [1 + 10**9 * (n + 1) // (t + v) for n, t, v in rows]

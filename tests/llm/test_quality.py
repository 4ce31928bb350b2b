"""Quality statistics against a plain version, and the learned list on held-out labels."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from metermill.llm import quality

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " \n\t", "a", "a b c a b c", "x\nx\n\nx ", "a b\r\na b\r\n", "é ü\né ü\n", "a a a a", "#*$ %&|<> #", "eins\x0bzwei\x0c", "q\n" * 5, "w " * 40000, "no break  em"]


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + j for at in where.values() if len(at) > 1 for i in at for j in range(3)}
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)]


def test_counts_equal_plain_version(spark):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    got = quality.count_stats(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert [int(got[c][i]) for c in quality.COUNTS[:5]] == plain(t), (i, t and t[:80])


def test_learned_list_rejects_junk_and_keeps_the_rest(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    rows = quality.judge(docs, train).join(labels.join(train, "doc_id", "left_anti"), "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_learning_finds_planted_thresholds():
    rng = np.random.default_rng(3)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = ((x["a"] > 0.8) & (x["b"] <= 0.5)) | (x["c"] > 0.95)
    rules = quality.learn(x, bad, np.arange(3000) % 3 != 0)
    hit = np.zeros(3000, bool)
    for r in rules:
        hit |= quality._holds(x, r)
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() <= 0.03 * hit.sum()


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (None, "a b"), (2, "")]])
def test_odd_tables(spark, rows):
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, stat_order int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in quality.judge(docs, labels).collect()] == [False] * len(rows)
    assert quality.keep(docs, labels).columns == docs.columns

"""The machine on held-out labels and on disguised insults; the kernel against its definition."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from metermill.llm import toxicity as tx

SF = "/root/testdata/sf0.1"


def plain_kernel(x, y):
    def phi(w):
        w, out = "\x02" + w + "\x03", {}
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if k - i < tx.SPAN:
                out.setdefault((w[i], w[j], w[k]), []).append(tx.DECAY ** (k - i + 1))
        norm = np.sqrt(sum(v * v for vs in out.values() for v in vs))
        return {u: sum(v) / norm for u, v in out.items()}

    a, b = phi(x), phi(y)
    return sum(v * b[u] for u, v in a.items() if u in b)


def test_kernel_equals_definition():
    words = ["idiot", "id*iot", "thethe", "a", "aaaaaaa", "çéñ", "stupid"]
    got = tx.kernel(words, words)
    for i, x in enumerate(words):
        for j, y in enumerate(words):
            assert got[i, j] == pytest.approx(plain_kernel(x, y))
    assert np.linalg.eigvalsh(got).min() > -1e-9


def test_machine_equals_its_nystroem_form():
    pos, neg = ["idiot", "moron", "stupid"], ["the", "thing", "station", "and", "thread"]
    m = tx.train(pos, neg, pos + neg)
    assert (m.decide(pos) > 0).all() and (m.decide(neg) < 0).all()
    assert (m.decide(["id*iot", "mor-on", "iddiot", "idiots"]) > 0).all()


def test_units():
    u = tx.Units(pa.array(["The idiot, (IDIOT) x!", None, "", "i d i o t is a", "b. c"]))
    has = [{u.words[k] for k in u.unit[u.text == i]} for i in range(5)]
    assert has[0] == {"the", "idiot", "x"} and not has[1] and not has[2] and "idiot" in has[3] and has[4] == {"b", "c"}


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels, tx.score(docs, labels).join(labels, "doc_id", "left").collect()


def test_held_out_accuracy(scored):
    rows = [r for r in scored[2] if r.held_out and r.toxic is not None]
    hit = [r.predicted for r in rows if r.toxic == 1]
    wrong = [r.predicted for r in rows if r.toxic == 0]
    print(len(hit), np.mean(hit), len(wrong), np.mean(wrong))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored[2])
    assert np.mean(wrong) < 0.03 and np.mean(hit) > 0.8


def test_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 1, None)], "doc_id long, quality int, toxic int")
    for rows in ([], [(1, None, 2.0), (None, "", 1.0), (2, "a b", None), (2, "a b", None), (3, "x" * 300000, 0.0)]):
        got = tx.score(spark.createDataFrame(rows, "doc_id long, text string, score double"), labels).collect()
        assert len(got) == len(rows) and all(r.score == 0 and r.predicted == 0 for r in got)

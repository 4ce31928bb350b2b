"""Line dedup against plain counting."""

import hashlib
import random
import re

import pytest

from metermill.llm import lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, min_sites=5, min_words=3):
    where, keeper = {}, {}
    for i, t, s in rows:
        for x in (t or "").split("\n") if t is not None else []:
            if len(WORD.findall(x)) >= min_words:
                where.setdefault(x, set()).add(s)
                if i is not None:
                    keeper[x] = min(keeper.get(x, i), i)
    gone = {x for x, s in where.items() if len(s) >= min_sites}
    out = []
    for i, t, _ in rows:
        stay = None if t is None else [x for x in t.split("\n") if x not in gone or keeper.get(x) == i]
        out.append((i, None if t is None else "\n".join(stay), len(t.split("\n")) if t is not None else 0, len(stay or [])))
    return out


def compare(spark, rows):
    df = spark.createDataFrame([(*r, "ln") for r in rows], "doc_id long, text string, source string, ln_text string")
    want = plain(rows)
    md5 = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
    key = lambda r: tuple((x is None, x or 0 if not isinstance(x, str) else x) for x in r[:1]) + tuple(map(str, r))
    got = [(r.doc_id, r.text_md5, r.n_lines, r.n_kept) for r in lines.report(df).collect()]
    assert sorted(got, key=key) == sorted([(i, md5(t), n, k) for i, t, n, k in want], key=key)
    clean = lines.clean(df)
    assert clean.columns == df.columns
    assert sorted([(r.doc_id, r.text) for r in clean.collect()], key=str) == sorted([(i, t) for i, t, _, _ in want], key=str)


def test_sites_around_the_threshold(spark):
    rng = random.Random(7)
    pool = [" ".join(rng.choice("abcdefg") * 3 for _ in range(rng.randrange(1, 8))) + f" {i}" for i in range(60)]
    rows = []
    for i in range(400):
        s = f"s{rng.randrange(40)}" if i % 9 else None
        own = [f"line of its own {i} {j}" for j in range(3)]
        some = [x for k, x in enumerate(pool) if rng.random() < (k % 12) / 60]
        text = own + some
        rng.shuffle(text)
        rows.append((i * 31 % 997, "\n".join(text), s))
    compare(spark, rows)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None, "a"), (2, "", None), (3, "\n\n", "b"), (4, "x " * 200000, "c")],
        [(None, "one two three\n", f"s{i}") for i in range(6)],
        [(i, "one two three\nr\n", f"s{i % 5}") for i in range(40)] + [(3, "one two three\nr\n", "s3")],
    ],
)
def test_odd_tables(spark, rows):
    compare(spark, rows)


def test_emptied_documents_can_go(spark):
    df = spark.createDataFrame([(i, "one two three", f"s{i}") for i in range(6)] + [(9, "", "z"), (8, None, "z"), (7, "an other text", "z")], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in lines.clean(df, drop_emptied=True).collect()) == [0, 7, 8, 9]

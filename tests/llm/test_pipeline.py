"""Every stage on what the one before kept, against plain versions."""

import re

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline as cp
from metermill.llm import mixing, quality
from metermill.llm.shared import stored
from test_lines import plain as plain_lines
from test_minhash import plain as plain_groups
from test_mixing import plain_targets

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, SF), "stage")
        out.append(docs)
    return out


def test_columns_stay(stages):
    assert all(d.columns == stages[0].columns for d in stages[:5])


def test_quality(spark, stages):
    verdict = {r.doc_id: r.kept for r in quality.judge(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r.doc_id: r.text for r in stages[1].collect()} == {r.doc_id: r.text for r in stages[0].collect() if verdict[r.doc_id]}


def test_lines(stages):
    rows = [(r.doc_id, r.text, r.source) for r in stages[1].collect()]
    want = {i: t for i, t, n, k in plain_lines(rows) if n == k or WORD.search(t)}
    got = stages[2].collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_groups(stages):
    groups = plain_groups([(r.doc_id, r.text) for r in stages[2].collect()], 5)
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(i for i, (_, _, kept) in groups.items() if kept)


def test_mix(stages):
    size = lambda t: len(WORD.findall(t))
    sizes, taken, largest = {}, {}, {}
    for r in stages[3].collect():
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
        largest[r.source] = min(largest.get(r.source, 1 << 60), size(r.text) or 1 << 60)
    often = {}
    for r in stages[4].collect():
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
        often[r.doc_id] = often.get(r.doc_id, 0) + 1
    want = plain_targets(sizes)
    assert max(often.values()) <= 2 and all(abs(taken.get(s, 0) - want[s]) <= max(0.05 * want[s], largest[s]) for s in sizes)
    assert {r.doc_id: r.copies for r in mixing.rates(stages[3]).collect() if r.copies} == often


def test_ids(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count() and all(r.ids == library.encode(texts[r.doc_id]) and r.same for r in rows)


def test_run_and_empty_table(spark, stages, tmp_path):
    assert sorted((r.doc_id, r.n_pieces) for r in cp.run(spark, SF).collect()) == sorted((r.doc_id, r.n_pieces) for r in stages[5].collect())
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []

"""Token counts against the tokenizer library."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from metermill.llm import tokens

FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "'ll", "don't we've I'll x'r x'v x'l 're 'rex ''s '' s  's\n's \n 't  \n", "a<|endoftext|>b  <|endoftext|>", "   ", "\n\n\n x", "=" * 3000, "ab" * 3000, " " * 5000, "漢字" * 500, "\x00\x1c\x85 x"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def test_random_texts(library):
    rng = random.Random(1)
    alphabet = list(" '  \n\t  　stmdrevlSTabc019.,!?#*$é漢字😀́ \x85\x1cⅧ½")
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 300))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0x3000), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(30)) for _ in range(1000)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    machine = tokens.Counter(FILE)
    got = np.concatenate([machine.count(texts[i : i + 97]) for i in range(0, len(texts), 97)])
    assert got.tolist() == want


def test_scan_equals_one_state_after_the_other():
    rng = np.random.default_rng(2)
    to, marks = tokens.transitions()
    classes = rng.integers(0, tokens.STOP, 5000).astype(np.uint8)
    classes[rng.integers(0, 5000, 90)] = tokens.STOP
    classes[-1] = tokens.STOP
    want, s = np.zeros(5000, bool), tokens.START
    for i, c in enumerate(classes):
        m, s = marks[s * tokens.CLASSES + c], to[s * tokens.CLASSES + c]
        want[i] |= bool(m & tokens.HERE)
        want[i - 1] |= bool(m & tokens.BEFORE)
    want[classes == tokens.STOP] = False
    assert (tokens.begins(classes) == want).all()


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = tokens.with_counts(docs.select("doc_id", "text"), FILE).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


@pytest.mark.parametrize("rows", [[], [(1, None, 3), (None, "", 4), (2, "x " * 60000, None), (2, "x", 5)]])
def test_odd_tables(spark, library, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = tokens.with_counts(df, FILE)
    assert got.columns == ["doc_id", "n_chars", "n_bytes", "n_tokens", "over_limit"]
    want = sorted(len(library.encode(t or "").ids) for _, t, _ in rows)
    assert sorted(r.n_tokens for r in got.collect()) == want

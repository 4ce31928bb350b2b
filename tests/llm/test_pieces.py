"""Encoding and decoding against the SentencePiece library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from metermill.llm import pieces

FILE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


@pytest.fixture(scope="module")
def machine():
    return pieces.Transducer(FILE)


def split(flat, counts):
    ends = np.cumsum(counts)
    return [flat[e - n : e].tolist() for e, n in zip(ends, counts)]


def test_random_texts(library, machine):
    rng = random.Random(1)
    alphabet = list(" '  \n\t▁ 　stmdrevlSTabc019.,!?#*$é漢字😀́ \x85\x1cⅧ½<s>/")
    texts = ["", " ", " x ", "▁a", "a\x00b", "<s> </s> <unk> <0x41>", "=" * 4000, "ab" * 3000, "漢" * 900] + [" " * k + "x" * (k % 3) for k in range(80)]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0x3000), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(30)) for _ in range(1000)]
    for i in range(0, len(texts), 331):
        part = texts[i : i + 331]
        flat, counts = machine.encode(part)
        want = [library.encode(t) for t in part]
        assert split(flat, counts) == want
        assert machine.decode(flat, counts) == [library.decode(w) for w in want]


def test_random_ids_decode(library, machine):
    rng = random.Random(4)
    rows = [[rng.randrange(top) for _ in range(rng.randrange(9))] for top in (32000, 400, 259) for _ in range(800)]
    got = machine.decode(np.array([i for r in rows for i in r], np.int64), np.array([len(r) for r in rows]))
    assert got == [library.decode(r) for r in rows]


def test_whole_table_round_trip(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pieces.decoded(pieces.encoded(docs, FILE), FILE).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        assert r.sp_ids == library.encode(t) and r.sp_same and r.sp_text == t and r.sp_back == hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("rows", [[], [(1, None, 3), (None, "", 4), (2, "x " * 60000, None), (2, "▁x", 5)]])
def test_odd_tables(spark, library, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes long")
    got = pieces.encoded(df, FILE)
    assert got.columns[:3] == ["doc_id", "text", "n_bytes"]
    key = lambda x: (x is None, x or [])
    assert sorted((r.sp_ids for r in got.collect()), key=key) == sorted((None if t is None else library.encode(t) if t else [] for _, t, _ in rows), key=key)

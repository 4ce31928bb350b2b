"""Strings that collide under every polynomial hash modulo a power of two (Thue-Morse words and their complements)."""

import numpy as np
import pyarrow as pa
import pytest

from metermill.llm import lm, minhash, pieces, quality, tokens
from metermill.llm.queries import tokenizer
from metermill.llm.text import Words, joint_codes, span_codes, span_hash


def thue_morse(letters, size):
    return "".join(letters[bin(i).count("1") % 2] for i in range(size))


PAIRS = [(thue_morse(a + b, n), thue_morse(b + a, n)) for a, b in ("eq", "ab", "AZ", "xé") for n in (1024, 2048, 4096)]


def test_hashes_differ():
    texts = [t for p in PAIRS for t in p]
    h = Words(pa.array(texts)).hashes()
    assert len(set(h.tolist())) == len(set(texts))


def test_hash_depends_on_bytes_alone():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 3, 5000).astype(np.uint8)
    starts = rng.integers(0, 4000, 3000)
    ends = starts + rng.integers(0, 60, 3000)
    h, (codes, _) = span_hash(data, starts, ends), span_codes(data, starts, ends)
    seen = {}
    for i, (a, b) in enumerate(zip(starts, ends)):
        key = data[a:b].tobytes()
        assert seen.setdefault(key, (h[i], codes[i])) == (h[i], codes[i])
    assert len(set(h.tolist())) == len(set(codes.tolist())) == len(seen)


def test_joint_codes_are_exact():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 1 << 40, 2000) // (1 << 38) * ((1 << 38) + 7) for _ in range(5)]
    codes = joint_codes(columns)
    rows = list(zip(*[c.tolist() for c in columns]))
    assert len(set(codes.tolist())) == len(set(rows)) and all((codes[i] == codes[j]) == (rows[i] == rows[j]) for i in range(40) for j in range(40))


def test_token_counts_equal_the_library():
    from tokenizers import Tokenizer

    file = tokenizer("byte_bpe_50k.json")
    library, counter = Tokenizer.from_file(file), tokens.Counter(file)
    texts = [t for p in PAIRS for t in p]
    assert counter.count(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_sentencepiece_ids_equal_the_library():
    import sentencepiece

    file = tokenizer("piece_bpe_32k.model")
    library, machine = sentencepiece.SentencePieceProcessor(model_file=file), pieces.Transducer(file)
    texts = [t for p in PAIRS for t in p]
    ids, counts = machine.encode(texts)
    ends = np.cumsum(counts)
    assert [ids[e - c : e].tolist() for e, c in zip(ends, counts)] == [library.encode(t) for t in texts]
    assert machine.decode(ids, counts) == texts


@pytest.mark.parametrize("a,b", PAIRS)
def test_different_lines_and_words_do_not_repeat(a, b):
    got = quality.count_stats(pa.array([f"{a}\n{b}", f"{a}\n{a}", f"{a} x {b} x {a}", f"{a} x y {b} x y", f"{a} x y {a} x y"]))
    assert got["n_dup_lines"].tolist() == [0, 1, 0, 0, 0]
    assert got["n_repeat_words"].tolist() == [0, 0, 0, 0, 6]


def test_different_shingles_are_no_copies(spark):
    rows = [(2 * i + j, " ".join([t] * 4)) for i, p in enumerate(PAIRS) for j, t in enumerate(p)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same = {i: min(j for j, u in rows if u.lower() == t.lower()) for i, t in rows}
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, shingle=4).collect()} == same


def test_base_score_counts_words_apart(spark):
    a, b = PAIRS[0]
    df = spark.createDataFrame([(i, f"{a} {b}") for i in range(8)], "doc_id long, text string")
    rows = lm.score(df).collect()
    train = sum(not r.held_out for r in rows)
    total, kinds = 3 * train, 3
    want = sum(np.log10((train + 1) / (total + kinds + 1)) for _ in range(3))
    assert all(r.train_tokens == total and r.n_known == 3 for r in rows)
    assert {round(r.base_score, 9) for r in rows} == {round(want, 9)}

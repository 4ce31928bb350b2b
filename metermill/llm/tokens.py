"""Token counts of a byte-level tokenizer by finite-state machines.

Two deterministic transducers.  The first reads classes of code points and marks where pre-tokens begin; it sees one
character late what follows white space or an apostrophe, so a transition may also mark the character before.  A batch
of texts is one string that is cut into short chunks: each chunk's map from entry state to exit state is computed for all
states at once, the maps are composed by a parallel prefix scan, and with the entry states known all chunks emit their
marks together.  The second is the lattice automaton of the merges (``merges.py``): reading a pre-token, every position
carries the tokens of the prefix so far, transitions add their difference, and the sum is the count.

Defined results: null and empty texts have no tokens; strings of added tokens inside a text are that token, as the
library does it; repeated rows are counted each; an empty table gives an empty table; other columns pass
through, but those named like results are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .merges import Lattice, Memo
from .shared import prepare, without
from .text import slices, span_codes

CHUNK = 128

# Classes of code points.  Letters that contractions use have their own; STOP stands after each text.
LETTER, ST, RV, E, L, NUMBER, SPACE, WHITE, QUOTE, OTHER, STOP = range(11)
CLASSES = 16
# States: START and DONE expect a new pre-token; one or more white spaces, the last a blank (B) or not (W);
# a quote that may begin a contraction, and such a quote with r or v, or with l.
START, LETTERS, NUMBERS, OTHERS, B1, W1, B2, W2, APOS, APOS_RV, APOS_L, DONE = range(12)
STATES = 12
HERE, BEFORE = 1, 2

_LETTERS = (LETTER, ST, RV, E, L)


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks for state * CLASSES + class."""
    to, marks = np.zeros((STATES, CLASSES), np.uint8), np.zeros((STATES, CLASSES), np.uint8)
    begin = {**dict.fromkeys(_LETTERS, LETTERS), NUMBER: NUMBERS, SPACE: B1, WHITE: W1, QUOTE: APOS, OTHER: OTHERS}
    for s in range(STATES):
        for c, t in begin.items():
            to[s, c], marks[s, c] = t, HERE
        to[s, STOP] = START
    for s, goes_on in ((LETTERS, _LETTERS), (NUMBERS, (NUMBER,)), (OTHERS, (OTHER, QUOTE))):
        for c in goes_on:
            to[s, c], marks[s, c] = s, 0
    for c in (OTHER, QUOTE):
        to[APOS, c], marks[APOS, c] = OTHERS, 0
    for c, t in ((ST, DONE), (RV, APOS_RV), (L, APOS_L)):
        to[APOS, c], marks[APOS, c] = t, 0
    for s, closes in ((APOS_RV, E), (APOS_L, L)):
        for c in range(STOP + 1):
            if c == closes:
                to[s, c], marks[s, c] = DONE, 0
            else:  # no contraction: the letter before began a word
                to[s, c], marks[s, c] = to[LETTERS, c], marks[LETTERS, c] | BEFORE
    for s, late in ((B1, 0), (B2, BEFORE)):
        for c in (*_LETTERS, NUMBER, OTHER, QUOTE):
            to[s, c], marks[s, c] = OTHERS if c == QUOTE else begin[c], late
    for c in (*_LETTERS, NUMBER, OTHER, QUOTE):
        marks[W2, c] = HERE | BEFORE
    for s in (B1, W1, B2, W2):
        to[s, SPACE], to[s, WHITE] = B2, W2
        marks[s, SPACE] = marks[s, WHITE] = 0
    return to.ravel(), marks.ravel()


def code_point_classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    shift = lambda i: i if i < 0xD800 else i + 0x800
    for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        for m in regex.finditer(pattern, every):
            table[shift(m.start()) : shift(m.end() - 1) + 1] = value
    for chars, value in (("stmd", ST), ("rv", RV), ("e", E), ("l", L), (" ", SPACE), ("'", QUOTE)):
        for ch in chars:
            table[ord(ch)] = value
    return table


def begins(classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, from the classes of texts that each end with STOP."""
    to, marks = transitions()
    n = len(classes)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, STOP, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T).astype(np.int32)
    wide = to.astype(np.int32) * CLASSES
    maps = np.broadcast_to(np.arange(STATES, dtype=np.int32)[:, None] * CLASSES, (STATES, rows)).copy()
    for j in range(CHUNK):
        maps = wide.take(maps + grid[j])
    maps //= CLASSES
    step = 1
    while step < rows:  # inclusive scan: first what came before, then the chunk
        maps[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step].copy(), axis=0)
        step *= 2
    state = np.zeros(rows, np.int32)
    state[1:] = maps[START, :-1] * CLASSES
    out = np.empty((CHUNK, rows), np.uint8)
    for j in range(CHUNK):
        at = state + grid[j]
        out[j] = marks.take(at)
        state = wide.take(at)
    flags = out.T.ravel()[:n]
    first = (flags & HERE).astype(bool)
    first[:-1] |= (flags[1:] & BEFORE).astype(bool)
    first[classes == STOP] = False
    return first


class Counter:
    """A compiled tokenizer: counts the tokens of texts."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("only byte-level BPE without normalizer and prefix space is compiled")
        self.added = [t["content"] for t in spec["added_tokens"]]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        number = {ch: b for ch, b in shown.items()}
        pieces = [(b,) for b in range(256)]
        left, right = list(range(256)), list(range(256))
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            if a + b in number:
                raise ValueError("a token with two merges")
            number[a + b] = len(pieces)
            left.append(number[a]), right.append(number[b])
            pieces.append(pieces[number[a]] + pieces[number[b]])
        self.lattice = Lattice(pieces, np.array(left), np.array(right), 1 << 20)
        self.classes = code_point_classes()
        self.memo: Memo | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": None}

    def count(self, texts: list[str | None]) -> np.ndarray:
        self.memo = self.memo or Memo()
        parts, of, extra = [], [], np.zeros(len(texts), np.int64)
        split = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        for i, t in enumerate(texts):
            if not t:
                continue
            pieces = [t]
            if split is not None and any(a in t for a in self.added):
                pieces = split.split(t)
                extra[i] = len(pieces) - 1
            for p in pieces:
                if p:
                    parts.append(p)
                    of.append(i)
        if not parts:
            return extra
        whole = "\n".join(parts) + "\n"
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) + 1 for p in parts])
        classes = self.classes[codes]
        classes[ends - 1] = STOP
        at = np.flatnonzero(begins(classes))
        owner = np.searchsorted(ends, at, "right")
        stop = np.minimum(np.append(at[1:], len(codes)), ends[owner] - 1)
        which, spans = span_codes(codes.view(np.uint8), 4 * at, 4 * stop)
        keys = spans.to_pylist()
        new = self.memo.missing(keys)
        if len(new):
            some = [keys[i] for i in new.tolist()]
            words = [k.decode("utf-32-le").encode() for k in some]
            ptr = np.concatenate([[0], np.cumsum([len(w) for w in words])])
            _, counts = self.lattice.encode(np.frombuffer(b"".join(words), np.uint8).astype(np.int64), ptr)
            self.memo.add(some, counts.astype(np.int32), np.ones(len(new), np.int64))
        starts, _ = self.memo.find(keys)
        each = self.memo.flat[starts][which]
        return extra + np.bincount(np.array(of)[owner], each, len(texts)).astype(np.int64)


def with_counts(docs: DataFrame, file: str, text_col: str = "text", limit: int = 512) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit instead of the text."""
    prepare(docs.sparkSession)
    counter = docs.sparkSession.sparkContext.broadcast(Counter(file))
    docs = without(docs, {"n_bytes", "n_tokens", "over_limit", "tk_text"})
    rest = [c for c in docs.columns if c != text_col]
    used = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`").alias("tk_text"))
    names = [*rest, "n_bytes", "n_tokens"]
    schema = used.drop("tk_text").select("*", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter.value
        for batch in batches:
            for part in slices(batch, "tk_text"):
                texts = part.column("tk_text")
                size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], size, pa.array(machine.count(texts.to_pylist()))], names=names)

    return used.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)

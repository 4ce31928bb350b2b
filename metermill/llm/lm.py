"""Scores of a word bigram model held as a weighted backoff automaton.

States are the words seen in training (and the end mark, which also is the state before a text) plus a root.  State u has an
arc for every word w that followed it in training, with weight log10(l * c(uw) / c(u) + (1 - l) * p0(w)), and a failure arc
to the root with weight log10(1 - l), where the root's arcs have p0(w) = (c(w) + 1) / (N + V + 1) and unknown words share one
more event of that form.  l depends on the power of two of c(u) and is the one that leaves-one-out training likes best.
Probabilities of a state sum to one.  The automaton is not walked: with bigrams the arc, or the failure arc and the root's arc,
depend on the pair of tokens alone, so each distinct pair of a chunk gets its weight once and a text adds those of its pairs.

How the counts travel: texts are packed into chunks of ``CHUNK`` bytes.  A chunk's distinct words and word pairs, with its
training counts, go as sorted runs of 64-bit keys to the reducer of their key range; the reducer adds up and answers each
chunk with the totals of its own keys.  So a chunk gets just the part of the automaton that its texts can reach, a key
is sent once a chunk however often it occurs, and neither the vocabulary nor the model is ever in one place.

Defined results: null and empty texts are the end mark alone; a null id is in the fold of the empty string; repeated rows
count (and score) each; without training text N = V = 0 and every token has probability 1; an empty table gives an empty
table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import prepare, stored
from .text import SLICE_BYTES, U, Words, mixed, slices

#: Bytes of text of a chunk (one text at least), and keys of a reducer.
CHUNK = 6 << 20
KEYS = 1_000_000
FOLDS, HELD_OUT = 7, 2
#: Histogram of log2 of (bigram share over p0): first bin (0 itself is its own), bins in a doubling, number of bins.
LOW, STEP, BINS = -20, 8, 480

END = mixed(np.array([0x454E44], U))[0]


# --- packing ----------------------------------------------------------------------------------------------------


def pack(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T
    return x.dtype.char.encode() + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True) if len(x) else x.dtype.char.encode()


def unpack(b: bytes, n: int) -> np.ndarray:
    kind = np.dtype(bytes(b[:1]).decode())
    if not n:
        return np.zeros(0, kind)
    raw = pa.decompress(b[1:], decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=U(0)))


def unpack_sorted(b: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(b, n), dtype=U)


# --- chunks ------------------------------------------------------------------------------------------------------


class Chunk:
    """Tokens of a chunk as local word numbers (0: end mark), and its pairs; all from ``tokens`` and ``ends``."""

    def __init__(self, tokens: np.ndarray, ends: np.ndarray, hashes: np.ndarray):
        self.tokens, self.ends, self.hashes = tokens, ends, hashes
        before = np.zeros(len(tokens), np.int64)
        before[1:] = tokens[:-1]  # an end mark is the state before the next text
        code = before * len(hashes) + tokens
        pairs, self.pair_of = np.unique(code, return_inverse=True)
        self.first, self.second = pairs // len(hashes), pairs % len(hashes)
        words = mixed(hashes + U(5)) & ~U(1)
        both = mixed(hashes[self.first] * U(31) + mixed(hashes[self.second])) | U(1)
        keys = np.concatenate([words, both])
        order = np.argsort(keys)
        self.keys = keys[order]
        self.place = np.empty(len(keys), np.int64)
        self.place[order] = np.arange(len(keys))

    def counts(self, train: np.ndarray) -> np.ndarray:
        """Training counts by sorted key; ``train`` marks texts."""
        sizes = np.diff(self.ends, prepend=0)
        weight = np.repeat(train, sizes).astype(float)
        out = np.zeros(len(self.keys), np.int64)
        w = np.bincount(self.tokens, weight, len(self.hashes))
        p = np.bincount(self.pair_of, weight, len(self.first))
        out[self.place] = np.concatenate([w, p]).astype(np.int64)
        return out

    def per_text(self, x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(x)])
        return sums[self.ends] - sums[np.concatenate([[0], self.ends[:-1]])]


def _fold(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def _chunk_row(number: int, parts: list[tuple[list, np.ndarray, np.ndarray]]) -> dict:
    ids = [i for p in parts for i in p[0]]
    words = np.concatenate([p[1] for p in parts])
    hashes, local = np.unique(words, return_inverse=True)
    hashes = np.concatenate([[END], hashes])  # the end mark is number 0
    sizes = np.concatenate([p[2] for p in parts])
    ends = np.cumsum(sizes + 1)
    tokens = np.zeros(len(words) + len(ids), np.int64)
    mark = np.ones(len(tokens), bool)
    mark[ends - 1] = False
    # numbers by falling frequency pack best
    rank = np.empty(len(hashes), np.int64)
    by = np.concatenate([[0], 1 + np.argsort(-np.bincount(local, minlength=len(hashes) - 1), kind="stable")]) if len(words) else np.zeros(1, np.int64)
    rank[by] = np.arange(len(hashes))
    tokens[mark] = rank[local + 1]
    hashes = hashes[by]
    held = np.array([_fold(i) == HELD_OUT for i in ids])
    return {
        "chunk": number, "doc_ids": ids, "held": held.tolist(), "n_tokens": len(tokens), "n_words": len(hashes), "n_train": int((np.diff(ends, prepend=0) * ~held).sum()),
        "tokens": pack(tokens.astype(np.int32)), "ends": pack(ends.astype(np.int64)), "hashes": pack(hashes),
    }


def _chunk_of(row: dict) -> Chunk:
    return Chunk(unpack(row["tokens"], row["n_tokens"]).astype(np.int64), unpack(row["ends"], len(row["doc_ids"])), unpack(row["hashes"], row["n_words"]))


CHUNK_SCHEMA = (
    "chunk long, doc_ids array<long>, held array<boolean>, n_tokens long, n_words long, n_train long, tokens binary, ends binary, hashes binary"
)


def chunks(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK) -> DataFrame:
    prepare(docs.sparkSession)
    used = docs.select(F.col(f"`{id_col}`").cast("long").alias("lm_id"), F.col(f"`{text_col}`").alias("lm_text"))
    schema = pa.schema([
        ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n_tokens", pa.int64()), ("n_words", pa.int64()),
        ("n_train", pa.int64()), ("tokens", pa.binary()), ("ends", pa.binary()), ("hashes", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part in slices(batch, "lm_text", min(chunk_bytes, SLICE_BYTES)):
                w = Words(part.column("lm_text"), lower=True)
                if parts and size + len(w.data) > chunk_bytes:
                    yield pa.RecordBatch.from_pylist([_chunk_row(number, parts)], schema)
                    number, parts, size = number + 1, [], 0
                parts.append((part.column("lm_id").to_pylist(), w.hashes(), w.count()))
                size += len(w.data)
        if parts:
            yield pa.RecordBatch.from_pylist([_chunk_row(number, parts)], schema)

    return stored(used.mapInArrow(run, CHUNK_SCHEMA), "chunks")


# --- totals ------------------------------------------------------------------------------------------------------


def totals(packed: DataFrame) -> DataFrame:
    """Answers: chunk, part, n, totals (2 * total + 1 where this chunk speaks for the key), and the part's new words."""
    all_keys = packed.agg(F.sum(F.col("n_tokens") + F.col("n_words"))).first()[0] or 0  # no more than that
    n_parts = max(1, math.ceil(all_keys / KEYS))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                chunk = _chunk_of(row)
                k, c = chunk.keys, chunk.counts(~np.array(row["held"], bool)).astype(np.uint32)
                del chunk
                cut = np.searchsorted(((k >> U(32)) * U(n_parts)) >> U(32), np.arange(n_parts + 1).astype(U))
                some = np.flatnonzero(np.diff(cut))
                for at in range(0, len(some), 256):
                    each = some[at : at + 256]
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array(each, pa.int64()), "chunk": pa.array([row["chunk"]] * len(each), pa.int64()), "n": pa.array(np.diff(cut)[each], pa.int64()),
                        "keys": pa.array([pack_sorted(k[cut[p] : cut[p + 1]]) for p in each], pa.binary()), "counts": pa.array([pack(c[cut[p] : cut[p + 1]]) for p in each], pa.binary()),
                    })

    def answered(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        n = table.column("n").to_numpy()
        keys = np.concatenate([unpack_sorted(k.as_py(), m) for k, m in zip(table.column("keys"), n, strict=True)])
        counts = np.concatenate([unpack(c.as_py(), m) for c, m in zip(table.column("counts"), n, strict=True)]).astype(np.int64)
        order = np.argsort(keys, kind="stable")  # in the order of chunks inside a key
        s = keys[order]
        first = np.concatenate([[True], s[1:] != s[:-1]])
        heads = np.flatnonzero(first)
        total = np.add.reduceat(counts[order], heads)
        out = np.empty(len(keys), np.int64)
        out[order] = np.repeat(total, np.diff(np.append(heads, len(s)))) * 2 + first
        words = int(((total > 0) & ((s[heads] & U(1)) == 0)).sum())
        ends = np.cumsum(n)
        return pa.table({
            "chunk": table.column("chunk"), "part": table.column("part"), "n": table.column("n"),
            "totals": pa.array([pack(out[e - m : e].astype(np.uint64)) for e, m in zip(ends, n, strict=True)], pa.binary()),
            "words": pa.array([words] + [0] * (len(n) - 1), pa.int64()),
        })

    requests = packed.drop("n_train").mapInArrow(asked, "part long, chunk long, n long, keys binary, counts binary")
    return stored(requests.groupBy("part").applyInArrow(answered, "chunk long, part long, n long, totals binary, words long"), "totals")


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.log2(np.maximum(c, 1)).astype(np.int64), -1)


def _shares(c: Chunk, total: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By local word: its count and p0; by local pair: its count, and its share of its state over p0 of its word."""
    by_key = total[c.place]
    word, pair = by_key[: len(c.hashes)], by_key[len(c.hashes) :]
    p0 = (word + 1) / (n + v + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(word[c.first] > 0, pair / word[c.first], 0.0) / p0[c.second]
    return word, p0, pair, share


def joined(packed: DataFrame, answers: DataFrame, n: int, v: int) -> DataFrame:
    """Chunks with the totals of their keys, and the leave-one-out histogram of the pairs that they speak for."""
    schema = "chunk long, doc_ids array<long>, held array<boolean>, n_tokens long, n_words long, tokens binary, ends binary, hashes binary, totals binary, cells array<long>, weights array<long>"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.slice(0, 1)
        right = right.sort_by("part")
        both = np.concatenate([unpack(t.as_py(), m.as_py()) for t, m in zip(right.column("totals"), right.column("n"), strict=True)]).astype(np.int64)
        total, speaks = both >> 1, (both & 1).astype(bool)
        c = _chunk_of({name: row.column(name)[0].as_py() for name in row.column_names})
        word, _, pair, _ = _shares(c, total, n, v)
        own = speaks[c.place][len(c.hashes) :] & (pair > 0)
        uw, u, w = pair[own], word[c.first][own], word[c.second][own]
        rest = (uw - 1) / np.maximum(u - 1, 1) / (w / (n + v))
        cell = np.zeros(len(rest), np.int64)
        some = rest > 0
        cell[some] = 1 + np.clip(np.floor((np.log2(rest[some]) - LOW) * STEP), 0, BINS - 2).astype(np.int64)
        cells, at = np.unique(_bucket(u) * BINS + cell, return_inverse=True)
        weights = np.bincount(at, uw, len(cells)).astype(np.int64)
        keep = row.select(["chunk", "doc_ids", "held", "n_tokens", "n_words", "tokens", "ends", "hashes"])
        for name, value, kind in (("totals", pack(total.astype(np.uint64)), pa.binary()), ("cells", cells.tolist(), pa.list_(pa.int64())), ("weights", weights.tolist(), pa.list_(pa.int64()))):
            keep = keep.append_column(name, pa.array([value], kind))
        return keep

    left = packed.drop("n_train").groupBy("chunk")
    return stored(left.cogroup(answers.drop("words").groupBy("chunk")).applyInArrow(run, schema), "joined")


def interpolation(cells: dict[int, int]) -> dict[int, float]:
    """For each power of two of c(u) the l that maximises the leave-one-out likelihood of the histogram."""
    by: dict[int, list[tuple[float, int]]] = {}
    for key, weight in cells.items():
        b, cell = divmod(key, BINS)
        by.setdefault(b, []).append((0.0 if cell == 0 else 2.0 ** (LOW + (cell - 0.5) / STEP), weight))
    out = {}
    for b, rows in by.items():
        r, w = np.array([x for x, _ in rows]), np.array([x for _, x in rows], float)
        lo, hi = 0.0, 1.0
        for _ in range(40):  # the likelihood is concave
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (w * (r - 1) / (1 - mid + mid * r)).sum() > 0 else (lo, mid)
        out[b] = min(lo, 0.999)
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    packed = chunks(docs, id_col, text_col, chunk_bytes)
    answers = totals(packed)
    n = packed.agg(F.sum("n_train")).first()[0] or 0
    v = answers.agg(F.sum("words")).first()[0] or 0
    ready = joined(packed, answers, n, v)
    cells = ready.select(F.explode(F.map_from_entries(F.arrays_zip("cells", "weights"))).alias("cell", "weight")).groupBy("cell").agg(F.sum("weight").alias("weight"))
    mix = interpolation({r.cell: r.weight for r in cells.collect()})  # at most BINS cells for each power of two
    table = np.array([mix.get(b, 0.0) for b in range(64)] + [0.0])  # the last: words without a state

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                ids, c = row["doc_ids"], _chunk_of(row)
                word, p0, _, share = _shares(c, unpack(row["totals"], len(c.keys)).astype(np.int64), n, v)
                part = table[_bucket(word[c.first])]
                arc = np.log10(p0[c.second]) + np.log10(1 - part + part * share)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(np.diff(c.ends, prepend=0)),
                    "n_known": pa.array(c.per_text((word > 0)[c.tokens]).astype(np.int64)), "train_tokens": pa.array(np.full(len(ids), n, np.int64)),
                    "base_score": pa.array(c.per_text(np.log10(p0)[c.tokens])), "score": pa.array(c.per_text(arc[c.pair_of])),
                })

    wanted = ready.select("doc_ids", "held", "n_tokens", "n_words", "tokens", "ends", "hashes", "totals")
    return wanted.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

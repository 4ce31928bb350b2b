"""Document fingerprints from closed syncmers.

A k-mer (of UTF-8 bytes) is an anchor if its smallest inner s-mer is its first or its last one.  That depends on the k-mer
alone, so an edit moves no anchor outside its reach, and equal passages have equal anchors wherever they stand.  A
document's fingerprint is the ``KEPT`` smallest anchor hashes; the likeness of two fingerprints is the usual bottom-k
estimate of the share of common anchors.  ``anchors`` lists anchors with their positions, for positional matching.

``compare`` reads each document next to the one that follows it by falling id, in one shuffle of the texts: ids are cut into
blocks of near equal size, a block is sorted and streamed, and each block also gets the first document of the one below.

Defined results: null is empty; an empty text has an empty fingerprint, two empty ones have likeness 1 and an empty and another
0; a text without a syncmer (all with fewer than k bytes) has itself as the only anchor; null ids come last; rows with
equal ids follow each other by text; a single row is its own next; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import prepare, without
from .text import U, flat, mixed, slices

S, W = 6, 8
K = S + W - 1
KEPT = 64
#: Documents of a block, and the most blocks.
BLOCK, BLOCKS = 2000, 100_000
_LAST = -(1 << 63)


def anchor_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, position and hash of each anchor; texts without one are absent."""
    n = len(data)
    if n < K:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    m = n - S + 1
    h = np.zeros(m, np.uint32)
    for j in range(S):
        h *= np.uint32(0x01000193)
        h += data[j : j + m]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    h *= np.uint32(0x297A2D39)
    low = h
    for step in (1, 2, 4):  # minimum over W = 8 s-mers
        low = np.minimum(low[:-step], low[step:])
    at = np.flatnonzero((h[: len(low)] == low) | (h[W - 1 :] == low))
    of = np.searchsorted(offs, at, "right") - 1
    inside = at + K <= offs[of + 1]
    at, of = at[inside], of[inside]
    # S-mers at 0, S and K - S cover the k-mer (K <= 3 * S)
    key = mixed(h[at].astype(U) | (h[at + S].astype(U) << U(32)))
    return of, at - offs[of], mixed(key + h[at + K - S].astype(U) * U(0x9E3779B97F4A7C15))


def sketches(texts: pa.Array) -> list[np.ndarray]:
    """The smallest distinct anchor hashes of each text, as 32 leading bits in order."""
    data, offs = flat(texts)
    of, _, key = anchor_hashes(data, offs)
    key = (key >> U(32)).astype(np.uint32)
    ptr = np.searchsorted(of, np.arange(len(offs)))
    out = []
    for i in range(len(offs) - 1):
        own = key[ptr[i] : ptr[i + 1]]
        if len(own):
            out.append(np.unique(own)[:KEPT])
        elif offs[i + 1] > offs[i]:
            out.append(np.frombuffer(hashlib.sha256(data[offs[i] : offs[i + 1]].tobytes()).digest()[:4], ">u4").astype(np.uint32))
        else:
            out.append(np.zeros(0, np.uint32))
    return out


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    same = np.concatenate([both[1:] == both[:-1], [False]])
    first = np.concatenate([[True], both[1:] != both[:-1]])
    # the KEPT smallest of the union, and how many of them are in both
    shared = same[first][:KEPT]
    return float(shared.sum() / len(shared))


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with sy_fingerprint."""
    prepare(docs.sparkSession)
    docs = without(docs, {"sy_text", "sy_fingerprint"})
    used = docs.withColumn("sy_text", F.col(f"`{text_col}`"))
    schema = docs.select("*", F.lit("").alias("sy_fingerprint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "sy_text"):
                prints = [written(s) for s in sketches(part.column("sy_text"))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(prints, pa.string())], names=[*part.schema.names[:-1], "sy_fingerprint"])

    return used.mapInArrow(run, schema)


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pos (byte) and hash of every anchor."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "sy_text"):
                of, at, key = anchor_hashes(*flat(part.column("sy_text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(of)), pa.array(at), pa.array(key.view(np.int64))], names=["doc_id", "pos", "hash"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("sy_text")).mapInArrow(run, "doc_id long, pos long, hash long")


def _blocks(ids: DataFrame) -> tuple[np.ndarray, dict[int, list[int]]]:
    """Upper ends of the blocks, and for each id that is first below a block the blocks that it follows."""
    rows = ids.count()
    n = max(1, min(BLOCKS, -(-rows // BLOCK)))
    cuts = ids.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 20 * n).alias("cuts")).first()[0] or []
    ends = np.unique(np.array(cuts if n > 1 else [], np.int64))

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int] = {}
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            of = np.searchsorted(ends, keys, "left")
            order = np.lexsort((keys, of))
            last = np.flatnonzero(np.append(of[order][1:] != of[order][:-1], True)) if len(of) else []
            for b, k in zip(of[order][last].tolist(), keys[order][last].tolist(), strict=True):
                best[b] = max(best.get(b, _LAST), k)
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(best), pa.int64()), "most": pa.array(list(best.values()), pa.int64())})

    top = {r.block: r.most for r in ids.mapInArrow(most, "block long, most long").groupBy("block").agg(F.max("most").alias("most")).collect()}
    follows: dict[int, list[int]] = {}
    some = sorted(top)
    for i, b in enumerate(some):  # the lowest block is followed by the first document of all
        follows.setdefault(top[some[i - 1]] if i else top[some[-1]], []).append(b)
    return ends, follows


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: see the query's contract."""
    spark = docs.sparkSession
    prepare(spark)
    used = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)).alias("key"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    ends, follows = _blocks(used.select("key"))
    firsts = np.array(sorted(follows), np.int64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            row, block = np.arange(len(keys)), np.searchsorted(ends, keys, "left")
            extra = [(i, b) for i in np.flatnonzero(np.isin(keys, firsts)).tolist() for b in follows[int(keys[i])]]
            own = pa.array([True] * len(row) + [False] * len(extra), pa.bool_())
            out = batch.take(pa.array(np.concatenate([row, np.array([i for i, _ in extra], np.int64)])))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate([block, np.array([b for _, b in extra], np.int64)])), own], names=["id", "key", "text", "block", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kept: list[tuple[int | None, str]] = []  # documents of one block in order

        def flush(chain: list[tuple[int | None, str]]) -> pa.RecordBatch:
            texts = [t for _, t in chain]
            edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in zip(texts, texts[1:])]
            own, changed = sketches(pa.array(texts, pa.large_string())), sketches(pa.array(edited, pa.large_string()))
            return pa.RecordBatch.from_arrays([
                pa.array([i for i, _ in chain[:-1]], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array([written(s) for s in own[:-1]]), pa.array([written(s) for s in changed]),
                pa.array([likeness(a, b) for a, b in zip(own, changed)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
            ], names=names)

        size, block, done = 0, None, False
        for batch in batches:
            for i, t, b, own in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "block", "own")), strict=True):
                if b != block:
                    kept, size, block, done = [], 0, b, False
                if done:  # further rows with the id of the first document below
                    continue
                kept.append((i, t))
                size += len(t)
                done = not own
                if len(kept) > 1 and (size > 1 << 19 or done):
                    yield flush(kept)
                    kept, size = kept[-1:], len(t)

    ready = used.mapInArrow(dealt, "id long, key long, text string, block long, own boolean").repartition("block").sortWithinPartitions("block", F.desc("own"), F.desc("key"), "text")
    return ready.select("id", "text", "block", "own").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

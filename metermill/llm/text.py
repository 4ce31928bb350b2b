"""Whole texts of an Arrow column as flat bytes, and their words and lines with hashes, in NumPy.

Everything works on slices of a few megabytes of text, so that the arrays of one task stay bounded; a single text longer
than that is a slice of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Keeps the first 0 .. 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], U)


def mixed(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes, equal hash, wherever they stand.

    A span is cut into words of eight bytes.  Each is mixed with its place in the span, and the sum is mixed again with the length: no
    polynomial, whose powers of two make whole families of strings collide.
    """
    if not len(starts):
        return np.zeros(0, U)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    size = ends - starts
    blocks = np.maximum((size + 7) >> 3, 1)
    first = np.cumsum(blocks) - blocks
    of = np.repeat(np.arange(len(starts)), blocks)
    place = np.arange(len(of)) - first[of]
    x = words[starts[of] + 8 * place] & _FIRST[np.minimum(size[of] - 8 * place, 8)]
    x = mixed(x ^ mixed((place.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)))
    return mixed(np.add.reduceat(x, first) + mixed(size.astype(U) ^ U(0xD6E8FEB86659FD93)))


def span_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of byte spans, the same for equal bytes alone (Arrow compares the bytes), and the distinct spans by number."""
    size = (ends - starts).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    if not len(size):
        taken = data[:0]
    elif (starts[1:] >= ends[:-1]).all() and size.all():  # one after the other: a byte a place is enough to tell what lies inside
        step = np.zeros(len(data) + 1, np.int8)
        step[starts] += 1
        step[ends] -= 1
        taken = data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    else:
        taken = data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)]
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(taken))]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def joint_codes(codes: list[np.ndarray]) -> np.ndarray:
    """One number for each row of several columns of numbers, the same for equal rows alone."""
    out = codes[0]
    for more in codes[1:]:
        span = int(more.max(initial=0)) + 1
        if int(out.max(initial=0)) >= (1 << 62) // span:
            out = np.unique(out, return_inverse=True)[1]
        out = out * span + more
    return out


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets; null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def as_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``limit`` bytes of text, one row at least."""
    texts = batch.column(column).cast(pa.large_string())
    ends = np.cumsum(np.nan_to_num(np.array(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False), float)))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of texts: starts and ends in ``data``; ``ptr[i]:ptr[i + 1]`` are those of text i."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        data, self.offs = flat(texts)
        self.data = LOWER[data] if lower else data
        n = len(data)
        inside = ~SPACE[data]
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            heads = self.offs[:-1][self.offs[:-1] < n]
            first[heads] |= inside[heads]
            tails = self.offs[1:][self.offs[1:] > 0] - 1
            last[tails] |= inside[tails]
        self.inside = inside
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.ptr = np.searchsorted(self.starts, self.offs)

    def __len__(self) -> int:
        return len(self.starts)

    def count(self) -> np.ndarray:
        return np.diff(self.ptr)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), self.count())

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return span_hash(self.data, starts, ends)

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """Sum of a byte-wise mark in each text."""
        sums = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(marks, out=sums[1:])
        return sums[self.offs[1:]] - sums[self.offs[:-1]]

    def codes(self) -> np.ndarray:
        """Numbers of the words, the same for equal words alone."""
        return span_codes(self.data, self.starts, self.ends)[0]

    def windows(self, k: int, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each window of k words that lies in one text."""
        h = self.hashes() if h is None else h
        at = self.window_starts(k)
        key = np.zeros(len(at), U)
        for j in range(k):
            key = mixed(key * U(31) + h[at + j])
        return at, key

    def window_starts(self, k: int) -> np.ndarray:
        """First word of each window of k words that lies in one text."""
        of = self.text_of_word()
        return np.flatnonzero(of[: len(of) - k + 1] == of[k - 1 :]) if len(of) >= k else np.zeros(0, np.int64)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, start and end of each line with a word."""
        n = len(self.data)
        cut = np.flatnonzero(self.data == 10)
        starts = np.union1d(self.offs[:-1], cut + 1)
        starts = starts[starts < n]
        ends = np.append(starts[1:], n)
        ends = ends - (self.data[ends - 1] == 10) if n else ends
        # a newline that ends one text's last line belongs to no line; those of the next text start at its offset
        some = np.searchsorted(self.starts, ends) > np.searchsorted(self.starts, starts)
        starts, ends = starts[some], ends[some]
        return np.searchsorted(self.offs, starts, "right") - 1, starts, ends


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys

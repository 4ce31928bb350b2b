"""Byte-pair merges as an automaton over the lattice of pieces.

A split of a text into pieces is what the merges produce exactly if each piece is reachable and each neighbouring pair
stays apart when merged on its own.  So the pieces become a trie (a transducer that reads symbols and emits a piece), the
pairs that stay apart become the arcs between pieces, all other arcs have infinite weight, and the one path of finite
weight through the composition with an input is its encoding.  The pair test peels both pieces along the split of their
last merge and asks whether an earlier merge would have crossed the border; it needs no table of pairs.

Pieces are numbered by merge order, single symbols first.  All inputs of a batch advance together, one position at a time.
"""

from __future__ import annotations

import numpy as np

from .text import U, mixed

_EMPTY = U(0xFFFFFFFFFFFFFFFF)
NONE = np.int64(1) << 62


class Table:
    """A fixed map from 64-bit keys to integers, looked up by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * max(len(keys), 1)).bit_length())
        self.keys = np.full(1 << self.bits, _EMPTY, U)
        self.values = np.zeros(1 << self.bits, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == _EMPTY
            heads = np.unique(slot[free], return_index=True)[1]
            put = left[free][heads]
            self.keys[slot[free][heads]], self.values[slot[free][heads]] = keys[put], values[put]
            rest = self.keys[slot] != keys[left]
            left, slot = left[rest], (slot[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys) >> U(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray, default: int = -1) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], default)
        left = np.flatnonzero((found != keys) & (found != _EMPTY))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.keys) - 1)
            found = self.keys[slot]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            go = ~hit & (found != _EMPTY)
            left, slot = left[go], slot[go]
        return out


class Lattice:
    """``pieces[t]`` are the symbols of piece t; ``left`` and ``right`` its last merge (itself for single symbols).

    ``tied`` pieces have one and the same merge priority, the lowest, and join from left to right; they are runs of one symbol
    and ``apart[i, j]`` says whether tied pieces i and j stay apart.  Symbols of ``unknown`` and above belong to no piece:
    they are pieces of their own that never merge.
    """

    def __init__(self, pieces: list[tuple[int, ...]], left: np.ndarray, right: np.ndarray, unknown: int, tied: np.ndarray | None = None, apart: np.ndarray | None = None):
        self.left, self.right, self.unknown = left.astype(np.int64), right.astype(np.int64), unknown
        self.count = len(pieces)
        merged = np.flatnonzero(self.left != np.arange(self.count))
        self.pairs = Table(self._pair(self.left[merged], self.right[merged]), merged)
        nodes: dict[tuple[int, int], int] = {}
        emits = [-1]
        for t, symbols in enumerate(pieces):
            if not symbols:  # no merges lead to it
                continue
            at = 0
            for s in symbols:
                to = nodes.get((at, s))
                if to is None:
                    to = nodes[at, s] = len(emits)
                    emits.append(-1)
                at = to
            emits[at] = t
        self.emits = np.array(emits, np.int64)
        keys = np.array([(a << 32) | s for a, s in nodes], U)
        self.arcs = Table(keys, np.array(list(nodes.values()), np.int32))
        self.tie = np.full(self.count, -1, np.int64)
        self.apart = apart
        if tied is not None and len(tied):
            self.tie[tied] = np.arange(len(tied))

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(U) << U(32)) | b.astype(U)

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        at = np.flatnonzero((a < self.count) & (b < self.count))
        a, b = a[at], b[at]
        ties = (self.tie[a] >= 0) & (self.tie[b] >= 0)
        if ties.any():
            out[at[ties]] = self.apart[self.tie[a[ties]], self.tie[b[ties]]]
            at, a, b = at[~ties], a[~ties], b[~ties]
        limit = np.full(len(a), NONE)
        while len(at):
            m = self.pairs.get(self._pair(a, b)).astype(np.int64)
            crossed = (m >= 0) & (m < limit)
            out[at[crossed]] = False
            at, a, b = at[~crossed], a[~crossed], b[~crossed]
            # undo the later of the two last merges; a single symbol has none
            can_a, can_b = self.right[a] != a, self.left[b] != b
            go = can_a | can_b
            at, a, b, can_a, can_b = at[go], a[go], b[go], can_a[go], can_b[go]
            undo_a = can_a & ((a > b) | ~can_b)
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return out

    def encode(self, symbols: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the inputs ``symbols[ptr[i]:ptr[i + 1]]``, flat, and how many each has."""
        n = len(ptr) - 1
        sizes = np.diff(ptr)
        of = np.repeat(np.arange(n), sizes)
        starts, ends_at, emitted = [], [], []
        pos, node, depth = np.arange(len(symbols)), np.zeros(len(symbols), np.int64), 0
        strange = symbols >= self.unknown
        lone = np.flatnonzero(strange)
        starts.append(lone), ends_at.append(lone + 1), emitted.append(symbols[lone].astype(np.int64) - self.unknown + self.count)
        pos, node = pos[~strange], node[~strange]
        while len(pos):
            to = self.arcs.get((node.astype(U) << U(32)) | symbols[pos + depth].astype(U))
            ok = to >= 0
            pos, node, depth = pos[ok], to[ok].astype(np.int64), depth + 1
            t = self.emits[node]
            e = t >= 0
            starts.append(pos[e]), ends_at.append(pos[e] + depth), emitted.append(t[e])
            more = pos + depth < ptr[of[pos] + 1]
            pos, node = pos[more], node[more]
        start, end, piece = (np.concatenate(x) for x in (starts, ends_at, emitted))
        word = of[start]
        reach = end - ptr[word]
        order = np.argsort(reach, kind="stable")
        start, end, piece, word, reach = start[order], end[order], piece[order], word[order], reach[order]
        # a slot for every position of every input, its begin included
        s, e = start + word, end + word
        last, back, number = np.full(len(symbols) + n, -1, np.int64), np.zeros(len(symbols) + n, np.int64), np.zeros(len(symbols) + n, np.int64)
        begin = ptr[:-1] + np.arange(n)
        longest = int(sizes.max()) if n else 0
        cut = np.searchsorted(reach, np.arange(1, longest + 2))
        for k in range(longest):
            x = slice(cut[k], cut[k + 1])
            si, ei, pi, wi = s[x], e[x], piece[x], word[x]
            before = last[si]
            ok = si == begin[wi]
            rest = np.flatnonzero(~ok & (before >= 0))
            ok[rest] = self.stay_apart(before[rest], pi[rest])
            last[ei[ok]], back[ei[ok]], number[ei[ok]] = pi[ok], si[ok], number[si[ok]] + 1
        final = ptr[1:] + np.arange(n)
        counts = number[final]
        base = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int64)
        at, w = final[sizes > 0], np.arange(n)[sizes > 0]
        while len(at):
            out[base[w] + number[at] - 1] = last[at]
            at = back[at]
            go = at != begin[w]
            at, w = at[go], w[go]
        return out, counts


class Memo:
    """Encodings by the input's bytes, kept from batch to batch in a worker; starts anew beyond ``most`` inputs or ``most_bytes`` of them."""

    def __init__(self, most: int = 300_000, most_bytes: int = 32 << 20):
        self.most, self.most_bytes = most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.flat, self.ptr = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
        self.used = self.key_bytes = 0

    def missing(self, keys: list[bytes]) -> np.ndarray:
        """Indices of the inputs it doesn't know; after it forgot everything, all of them."""
        if len(self.slot) + len(keys) > self.most or self.key_bytes > self.most_bytes:
            self.clear()
        return np.array([i for i, k in enumerate(keys) if k not in self.slot], np.int64)

    def add(self, keys: list[bytes], flat: np.ndarray, counts: np.ndarray) -> None:
        n, first = len(self.slot), self.used
        while first + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(keys) + 1 > len(self.ptr):
            self.ptr = np.concatenate([self.ptr, np.zeros_like(self.ptr)])
        self.flat[first : first + len(flat)] = flat
        self.ptr[n : n + len(keys) + 1] = first + np.concatenate([[0], np.cumsum(counts)])
        self.used = first + len(flat)
        self.key_bytes += sum(map(len, keys))
        self.slot.update(zip(keys, range(n, n + len(keys)), strict=True))

    def find(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where each begins in ``flat``, and its length."""
        at = np.fromiter((self.slot[k] for k in keys), np.int64, len(keys))
        return self.ptr[at], self.ptr[at + 1] - self.ptr[at]


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one after the other."""
    total = int(counts.sum())
    base = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(base, counts) + np.repeat(starts, counts)

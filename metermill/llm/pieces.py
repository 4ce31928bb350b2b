"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Compiled from a model file: the normaliser (dummy prefix and escaped blanks; the model's own character map must be the
identity), the trie of pieces, the arcs between pieces that merges leave apart (``merges.py``), and byte fallback
for symbols outside the vocabulary.  A text is composed with it and the tropical shortest path is its encoding; with
the arcs that merges forbid at infinite weight one path is left.  Blanks cut the text where no piece can cross, so equal words
share one composition.  Decoding is the inverse transducer: pieces to text, byte pieces to bytes, the prefix dropped.

The model at hand is of the merge (BPE) kind, in which scores are priorities, not additive costs; hence the pair
arcs instead of a sum of piece scores.

Defined results: a null text gives null ids, an empty one none; the escape character U+2581 in a text is a blank, as in the
library; bytes that are no UTF-8 decode to U+FFFD; repeated rows are encoded each; an empty table gives an empty table; other
columns pass through, but those named like results (sp_...) are replaced.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .merges import Lattice, Memo, runs
from .shared import prepare, without
from .text import slices, span_codes

BLANK = "▁"
codecs.register_error("each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def _joined(parts: list[str], rank: dict[str, tuple]) -> list[str]:
    """Merges in order of rank, the leftmost first among equals: what a piece is made of when it stands alone."""
    while len(parts) > 1:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank), default=None)
        if best is None:
            break
        i = best[1]
        parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]
    return parts


class Transducer:
    def __init__(self, file: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(file, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("only merge models with the identity normaliser and escaped blanks are compiled")
        self.prefix = norm.add_dummy_prefix
        self.names = [p.piece for p in model.pieces]
        self.kinds = np.array([p.type for p in model.pieces])
        self.bytes = np.full(256, -1, np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == _BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
        self.unknown = int(np.flatnonzero(self.kinds == _UNKNOWN)[0])
        normal = {p.piece: (-p.score, i) for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        if any(BLANK in p.lstrip(BLANK) for p in normal):
            raise ValueError("a piece with a blank inside")
        score = {p: s for p, (s, _) in normal.items()}
        # runs of blanks share one score and join from left to right; all other scores differ
        tied = sorted((p for p in normal if set(p) == {BLANK} and len(p) > 1), key=len)
        if len({score[p] for p in tied}) > 1 or len({s for p, s in score.items() if p not in tied}) != len(normal) - len(tied) or any(score[tied[0]] < s for s in score.values()):
            raise ValueError("scores with ties that are no blanks")
        chars = sorted({c for p in normal for c in p})
        order = chars + sorted((p for p in normal if len(p) > 1 and p not in tied), key=score.get) + tied
        number = {p: t for t, p in enumerate(order)}
        left, right = np.arange(len(order)), np.arange(len(order))
        reachable = np.ones(len(order), bool)
        for t in range(len(chars), len(order)):
            p = order[t]
            under = {q: s for q, s in ((p[a:b], score.get(p[a:b])) for a in range(len(p)) for b in range(a + 2, len(p) + 1)) if s is not None and q != p}
            halves = _joined(list(p), under)
            reachable[t] = len(halves) == 2
            if reachable[t]:
                left[t], right[t] = number[halves[0]], number[halves[1]]
        runs_of = [BLANK, *tied]
        apart = np.array([[_joined([BLANK] * (len(a) + len(b)), score) == [a, b] for b in runs_of] for a in runs_of])
        self.symbol = np.arange(0x110000, dtype=np.int64) + len(chars)
        self.symbol[[ord(c) for c in chars]] = np.arange(len(chars))
        pieces = [tuple(int(self.symbol[ord(c)]) for c in p) if reachable[t] else () for t, p in enumerate(order)]
        self.lattice = Lattice(pieces, left, right, len(chars), np.array([number[p] for p in runs_of]), apart)
        self.ids = np.array([normal[p][1] if p in normal else -1 for p in order], np.int64)
        self.order, self.chars = order, chars
        self.memo: Memo | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": None}

    def _ids(self, pieces: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary ids of lattice pieces; what has none becomes its bytes."""
        known = pieces < self.lattice.count
        ids = np.full(len(pieces), -1, np.int64)
        ids[known] = self.ids[pieces[known]]
        lone = np.flatnonzero(ids < 0)
        if not len(lone):
            return ids, counts
        owner = np.repeat(np.arange(len(counts)), counts)
        # an unknown code point c is symbol c + (number of symbols), and piece c + (number of pieces)
        code = [ord(self.order[p]) if p < self.lattice.count else int(p) - self.lattice.count for p in pieces[lone].tolist()]
        spelled = [[int(self.bytes[b]) for b in chr(c).encode()] for c in code]
        spelled = [s if min(s) >= 0 else [self.unknown] for s in spelled]
        size = np.ones(len(pieces), np.int64)
        size[lone] = [len(s) for s in spelled]
        out = np.repeat(ids, size)
        out[runs((np.cumsum(size) - size)[lone], size[lone])] = [i for s in spelled for i in s]
        return out, np.bincount(owner, size, len(counts)).astype(np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and how many each has."""
        self.memo = self.memo or Memo()
        normal = [(" " if self.prefix else "") + t.replace(BLANK, " ") if t else "" for t in texts]
        sizes = np.array([len(t) for t in normal], np.int64)
        whole = "".join(normal)
        if not whole:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        blank = codes == 0x20
        cut = blank.copy()
        cut[1:] &= ~blank[:-1]
        heads = np.cumsum(sizes) - sizes
        cut[heads[sizes > 0]] = True
        at = np.flatnonzero(cut)
        stop = np.append(at[1:], len(codes))
        which, spans = span_codes(codes.view(np.uint8), 4 * at, 4 * stop)
        keys = spans.to_pylist()
        new = self.memo.missing(keys)
        if len(new):
            some = [keys[i] for i in new.tolist()]
            inputs = np.frombuffer(b"".join(some), np.uint32)
            symbols = self.symbol[np.where(inputs == 0x20, ord(BLANK), inputs)]
            ids, counts = self._ids(*self.lattice.encode(symbols, np.concatenate([[0], np.cumsum([len(k) // 4 for k in some])])))
            self.memo.add(some, ids.astype(np.int32), counts)
        first, length = self.memo.find(keys)
        each = length[which]
        flat = self.memo.flat[runs(first[which], each)]
        owner = np.searchsorted(np.cumsum(sizes), at, "right")
        return flat, np.bincount(owner, each, len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of runs of ids."""
        if not hasattr(self, "_spelled"):
            spell = [n.replace(BLANK, " ").encode() if k == _NORMAL else bytes([int(n[3:5], 16)]) if k == _BYTE else b"" for n, k in zip(self.names, self.kinds, strict=True)]
            spell[self.unknown] = " ⁇ ".encode()
            self._spelled = spell
            self._blank = np.array([n.startswith(BLANK) and k == _NORMAL for n, k in zip(self.names, self.kinds, strict=True)])
        out, at = [], 0
        spell = self._spelled
        for n in counts.tolist():
            run = ids[at : at + n]
            raw = b"".join([spell[i] for i in run.tolist()])
            at += n
            spoken = run[self.kinds[run] != _CONTROL][:1]
            out.append((raw[1:] if self.prefix and len(spoken) and self._blank[spoken[0]] else raw).decode("utf-8", "each-byte"))
        return out


def encoded(docs: DataFrame, file: str, text_col: str = "text") -> DataFrame:
    """``docs`` with sp_ids (array<int>), sp_bytes (how many of them are byte fallback) and sp_back, the decoded text's SHA-256
    and whether it is the text (``sp_same``)."""
    prepare(docs.sparkSession)
    machine = docs.sparkSession.sparkContext.broadcast(Transducer(file))
    added = {"sp_ids": "array<int>", "sp_bytes": "int", "sp_back": "string", "sp_same": "boolean"}
    docs = without(docs, {*added, "sp_text"})
    used = docs.withColumn("sp_text", F.col(f"`{text_col}`"))
    schema = docs.select("*", *[F.lit(None).cast(t).alias(c) for c, t in added.items()]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine.value
        for batch in batches:
            for part in slices(batch, "sp_text"):
                texts = part.column("sp_text").to_pylist()
                ids, counts = m.encode(texts)
                ends = np.cumsum(counts)
                fallback = np.concatenate([[0], np.cumsum((m.kinds == _BYTE)[ids])])
                null = np.array([t is None for t in texts], bool)
                back = m.decode(ids, counts)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), pa.int32(), mask=np.append(null, False))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
                cols = [
                    lists, pa.array((fallback[ends] - fallback[ends - counts]).astype(np.int32), mask=null),
                    pa.array([None if t is None else hashlib.sha256(b.encode()).hexdigest() for t, b in zip(texts, back, strict=True)], pa.string()),
                    pa.array([None if t is None else t.replace(BLANK, " ") == b for t, b in zip(texts, back, strict=True)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *cols], names=[*part.schema.names[:-1], *added])

    return used.mapInArrow(run, schema)


def decoded(rows: DataFrame, file: str, ids_col: str = "sp_ids", text_col: str = "sp_text") -> DataFrame:
    """``rows`` with the text that their ids spell (null for null)."""
    prepare(rows.sparkSession)
    machine = rows.sparkSession.sparkContext.broadcast(Transducer(file))
    rows = without(rows, {text_col})
    schema = rows.select("*", F.lit(None).cast("string").alias(text_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine.value
        for batch in batches:
            lists = batch.column(ids_col)
            counts = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = m.decode(lists.flatten().to_numpy(zero_copy_only=False), counts)
            texts = [None if n else t for n, t in zip(lists.is_null().to_pylist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])

    return rows.mapInArrow(run, schema)

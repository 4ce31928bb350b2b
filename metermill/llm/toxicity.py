"""Toxicity by a support vector machine over a gapped-subsequence string kernel, with Nystroem landmarks.

The kernel compares words by their subsequences of three characters that lie within five, each weighted by ``DECAY`` to the
power of its span; so an insult with letters between its letters, or with another ending, still resembles itself.
It is normalised by length.  Landmarks are training words; the Nystroem map K(x, L) K(L, L)^(-1/2) makes the machine
linear, and as the kernel is a product of explicit subsequence weights, the trained machine is one weight per subsequence of a
landmark, which the scoring pass looks up.

Labels belong to documents and only some of their words are to blame.  Training therefore looks at the words of
labelled sentences (a sample of labelled documents bounded by ``SAMPLE``): words that occur in many places of toxic documents and
hardly in clean ones, and a greedy choice of rarer ones that explain the toxic documents left, are the positive words.  Negative words
come from clean documents: the most frequent ones, and in a few rounds those that the machine ranks highest.  A
document's decision is that of its worst word; letters written apart form a word too, and long words are also read in windows.
A logistic curve fitted on the training documents turns decisions into scores.

Defined results: null and empty texts have the decision ``EMPTY``; without toxic and clean labels all scores are 0; a document
with several labels counts as toxic if one says so; repeated rows are scored each; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .merges import Table
from .shared import bucket, prepare, stored
from .text import U, Words, slices

FOLDS, HELD_OUT = 5, 0
#: Most labelled documents to learn from, candidate words for covering, landmarks, and negative words of each kind.
SAMPLE, CANDIDATES, LANDMARKS, NEGATIVES, ROUNDS = 20_000, 3000, 400, 1500, 4
#: Different words before it, or toxic documents, from which on a word that clean documents lack is surely to blame.
SURE = 8
DECAY, SPAN = 0.6, 5
WINDOW, STRIDE, LONG = 20, 6, 28
EMPTY = -3.0
RIDGE = 0.0005

OFFSETS = [(a, b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]
EDGE = np.zeros(256, bool)
EDGE[[*b".,!?;:\"'()[]{}<>*_~`|/\\-#$%&@+=^"]] = True


# --- kernel -----------------------------------------------------------------------------------------------------


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-case words: word, subsequence and weight of each feature, and each word's length norm."""
    marked = ["\x02" + w + "\x03" for w in words]
    size = np.array([len(w) for w in marked], np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    of = np.repeat(np.arange(len(words)), size)
    word, key, weight = [], [], []
    norm = np.zeros(len(words))
    for a, b in OFFSETS:
        n = len(codes) - a - b
        if n <= 0:
            continue
        at = np.flatnonzero(of[:n] == of[a + b :])
        word.append(of[at])
        key.append(codes[at] | (codes[at + a] << U(21)) | (codes[at + a + b] << U(42)))
        weight.append(np.full(len(at), DECAY ** (a + b + 1)))
        norm += np.maximum(size - a - b, 0) * DECAY ** (2 * (a + b + 1))
    if not word:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0), np.ones(len(words))
    return np.concatenate(word), np.concatenate(key), np.concatenate(weight), np.sqrt(np.maximum(norm, 1e-9))


def kernel(xs: list[str], ys: list[str]) -> np.ndarray:
    """K(x, y) for all words of both lists; for training sets, which are bounded."""
    wx, kx, vx, nx = features(xs)
    wy, ky, vy, ny = features(ys)
    known, col = np.unique(ky, return_inverse=True)
    right = np.zeros((len(known), len(ys)))
    np.add.at(right, (col, wy), vy / ny[wy])
    at = np.searchsorted(known, kx)
    hit = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == kx)
    out = np.zeros((len(xs), len(ys)))
    order = np.flatnonzero(hit)
    for part in np.array_split(order, max(1, len(order) // 20_000)):
        np.add.at(out, wx[part], right[at[part]] * (vx[part] / nx[wx[part]])[:, None])
    return out


class Machine:
    """A decision for each word: the sum of its subsequences' weights over its norm, plus a constant."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, constant: float):
        self.table, self.weights, self.constant = Table(keys, np.arange(len(keys), dtype=np.int32)), np.append(weights, 0.0), constant

    def decide(self, words: list[str]) -> np.ndarray:
        word, key, value, norm = features(words)
        hit = self.table.get(key)
        return np.bincount(word, self.weights[hit] * value, len(words)) / norm + self.constant


def train(positive: list[str], negative: list[str], landmarks: list[str]) -> Machine:
    """Squared-hinge machine on Nystroem features, by Newton steps on its primal."""
    k = kernel(landmarks, landmarks)
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    x = np.column_stack([kernel(positive + negative, landmarks) @ root, np.ones(len(positive) + len(negative))])
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    c = np.concatenate([np.full(len(positive), 1 / max(1, len(positive))), np.full(len(negative), 3 / max(1, len(negative)))]) / RIDGE
    w = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(60):
        active = y * (x @ w) < 1
        xa = x[active]
        nxt = np.linalg.solve(penalty + xa.T @ (xa * c[active, None]), xa.T @ (c[active] * y[active]))
        if np.abs(nxt - w).max() < 1e-9:
            break
        w = nxt
    alpha = root @ w[:-1]
    word, key, value, norm = features(landmarks)
    keys, at = np.unique(key, return_inverse=True)
    return Machine(keys, np.bincount(at, alpha[word] * value / norm[word], len(keys)), float(w[-1]))


# --- words of texts ------------------------------------------------------------------------------------------------


class Units:
    """Distinct lower-case units of texts: ``words``, and which of them each text has (``text``, ``unit``)."""

    def __init__(self, texts: pa.Array):
        w = Words(texts)
        s, e = w.starts.copy(), w.ends.copy()
        for move, at in ((1, lambda: s), (-1, lambda: e - 1)):  # punctuation at the edges
            go = np.arange(len(s))
            while len(go):
                go = go[(e[go] - s[go] > 1) & EDGE[w.data[at()[go]]]]
                if move > 0:
                    s[go] += 1
                else:
                    e[go] -= 1
        of = w.text_of_word()
        extra_of, extra = [], []
        single = np.concatenate([[False], (e - s) == 1, [False]])
        begin, end = np.flatnonzero(single[1:] & ~single[:-1]), np.flatnonzero(~single[1:] & single[:-1])
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            for t in np.unique(of[a:b]) if b - a > 2 else []:
                run = np.flatnonzero(of[a:b] == t) + a
                if len(run) > 2:
                    extra_of.append(t), extra.append(w.data[s[run]].tobytes().decode("utf-8", "replace").lower())
        h = w.span_hash(s, e)
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        raw = w.data.tobytes()
        words = [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)]
        self.words = words + extra
        self.text = np.concatenate([of, np.array(extra_of, np.int64)]).astype(np.int64)
        self.unit = np.concatenate([which, len(words) + np.arange(len(extra))]).astype(np.int64)
        self.hashes = distinct
        # the unit before each of the words, 0 at a text's begin
        self.before = np.zeros(len(of), np.int64)
        self.before[1:] = np.where(of[1:] == of[:-1], h[:-1].view(np.int64), 0)
        self.texts = len(w.ptr) - 1


def windowed(words: list[str]) -> tuple[list[str], np.ndarray]:
    """The words and the windows of long ones, and where each word's begin."""
    out, ptr = [], [0]
    for w in words:
        out.append(w)
        if len(w) > LONG:
            out += [w[i : i + WINDOW] for i in range(0, len(w) - WINDOW + STRIDE, STRIDE)]
        ptr.append(len(out))
    return out, np.array(ptr)


def worst(machine: Machine, words: list[str]) -> np.ndarray:
    """Decision of each word, windows included."""
    if not words:
        return np.zeros(0)
    out, ptr = windowed(words)
    return np.maximum.reduceat(machine.decide(out), ptr[:-1])


class Scorer:
    """Decisions of texts, with the decisions of known words kept in the worker."""

    def __init__(self, machine: Machine, most: int = 600_000):
        self.machine, self.most, self.known = machine, most, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def texts(self, texts: pa.Array) -> np.ndarray:
        u = Units(texts)
        if len(self.known) + len(u.words) > self.most:
            self.known = {}
        keys = u.hashes.tolist()
        n = len(keys)
        new = [i for i, k in enumerate(keys) if k not in self.known]
        self.known.update(zip([keys[i] for i in new], worst(self.machine, [u.words[i] for i in new]).tolist(), strict=True))
        value = np.concatenate([np.fromiter((self.known[k] for k in keys), float, n), worst(self.machine, u.words[n:])])
        out = np.full(u.texts, EMPTY)
        np.maximum.at(out, u.text, value[u.unit])
        return out


# --- learning --------------------------------------------------------------------------------------------------------


def _word_counts(sample: DataFrame) -> DataFrame:
    """word, toxic and clean: in how many sampled documents of each kind it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "tx_text"):
                u = Units(part.column("tx_text"))
                toxic = part.column("tx_toxic").to_numpy(zero_copy_only=False) == 1
                pairs = np.unique(u.text * (len(u.words) + 1) + u.unit)
                text, unit = pairs // (len(u.words) + 1), pairs % (len(u.words) + 1)
                t = np.bincount(unit, toxic[text], len(u.words)).astype(np.int64)
                c = np.bincount(unit, ~toxic[text], len(u.words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u.words, pa.string()), pa.array(t), pa.array(c)], names=["word", "toxic", "clean"])

    parts = sample.select("tx_text", "tx_toxic").mapInArrow(run, "word string, toxic long, clean long")
    return stored(parts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "words")


def _blamed(sample: DataFrame, candidates: list[tuple[str, int, int]]) -> list[str]:
    """Words to blame: all that follow ``SURE`` different words or more in toxic documents, then by greedy covering those that
    explain two further documents.  Counting what a word follows tells an insult from a word of one text with many copies."""
    number = {w: i for i, (w, _, _) in enumerate(candidates)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "tx_text"):
                u = Units(part.column("tx_text"))
                cand = np.array([number.get(w, -1) for w in u.words], np.int64)
                hit = cand[u.unit] if len(u.unit) else np.zeros(0, np.int64)
                before = np.concatenate([u.before, np.zeros(len(hit) - len(u.before), np.int64)])
                at = [np.flatnonzero((u.text == i) & (hit >= 0)) for i in range(u.texts)]
                cols = [pa.array([x[i].tolist() for i in at], pa.list_(pa.int64())) for x in (hit, before)]
                yield pa.RecordBatch.from_arrays(cols, names=["found", "before"])

    docs_of: dict[int, set[int]] = {}
    contexts: dict[int, set[int]] = {}
    rows = sample.filter("tx_toxic = 1").select("tx_text").mapInArrow(run, "found array<long>, before array<long>").collect()
    for d, r in enumerate(rows):
        for w, before in zip(r.found, r.before, strict=True):
            docs_of.setdefault(w, set()).add(d)
            contexts.setdefault(w, set()).add(before)
    worth = {w: min(len(docs_of[w]), len(contexts[w])) for w in docs_of}
    order = sorted((w for w in docs_of if worth[w] > 2 and worth[w] >= 8 * candidates[w][2]), key=lambda w: (-worth[w], candidates[w][0]))
    chosen = [w for w in order if worth[w] >= SURE]
    explained = set().union(*(docs_of[w] for w in chosen))
    left = {w: docs_of[w] - explained for w in order if worth[w] < SURE}
    while left:
        w = max(left, key=lambda i: (len(left[i]), worth[i], candidates[i][0]))
        if len(left[w]) < 2:
            break
        chosen.append(w)
        explained = left.pop(w)
        left = {i: rest for i, d in left.items() if (rest := d - explained)}
    return [candidates[w][0] for w in chosen]


def _variants(word: str) -> list[str]:
    """The word as it is often disguised: a sign between its letters, or one letter written twice."""
    if len(word) < 4:
        return []
    mid = len(word) // 2
    return ["*".join(word), word[:mid] + "-" + word[mid:], word[:mid] + word[mid - 1] + word[mid:]]


def _highest(words: DataFrame, machine: Machine, limit: int) -> list[str]:
    """The clean words that the machine ranks highest (a report of fixed length for training)."""
    ref = words.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = worst(ref.value, batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(d)], names=["word", "decision"])

    rows = words.select("word").mapInArrow(run, "word string, decision double").orderBy(F.desc("decision"), "word").limit(limit).collect()
    return [r.word for r in rows]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE) -> tuple[Machine, float, float] | None:
    """A machine and the logistic curve (slope, constant); None without labels of both kinds."""
    prepare(docs.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull() & (bucket(F.col("doc_id"), 0, FOLDS) != HELD_OUT)).groupBy(F.col("doc_id").alias("tx_id")).agg(F.max("toxic").alias("tx_toxic"))
    known = known.orderBy(F.xxhash64("tx_id", F.lit("toxic")), "tx_id").limit(sample_rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("tx_doc"), F.col(f"`{text_col}`").alias("tx_text")).filter("tx_text is not null")
    sample = texts.join(known, F.col("tx_doc") == F.col("tx_id")).dropDuplicates(["tx_text"]).select("tx_id", "tx_text", "tx_toxic")
    sample = stored(sample, "sample")
    words = _word_counts(sample)
    found = words.filter("toxic >= 3 and 8 * clean <= toxic").orderBy(F.desc("toxic"), "word").limit(CANDIDATES).collect()
    chosen = _blamed(sample, [(r.word, r.toxic, r.clean) for r in found])
    clean = words.filter("clean > 0 and not (toxic >= 3 and 8 * clean <= toxic)")
    frequent = [r.word for r in clean.orderBy(F.desc("clean"), "word").limit(NEGATIVES).collect()]
    if not chosen or not frequent:
        return None
    positive = chosen + [v for w in chosen for v in _variants(w)]
    negative, machine = list(frequent), None
    for _ in range(ROUNDS):
        landmarks = list(dict.fromkeys(chosen[: LANDMARKS // 2] + negative[len(frequent) :][: LANDMARKS // 4] + frequent[: LANDMARKS // 4]))
        machine = train(positive, negative, landmarks)
        negative = list(dict.fromkeys(negative + _highest(clean, machine, NEGATIVES)))
    decisions = _decisions(sample.select("tx_id", "tx_text", "tx_toxic"), machine).select("tx_toxic", "tx_decision").collect()
    slope, constant = _logistic(np.array([r.tx_decision for r in decisions]), np.array([r.tx_toxic == 1 for r in decisions]))
    return machine, slope, constant


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and constant of the curve, by damped Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + 0.02 * a, (p - y).sum()])
        h = np.array([[(w * x * x).sum() + 0.02, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        step *= min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 1e-3), float(b)


def _decisions(rows: DataFrame, machine: Machine) -> DataFrame:
    """``rows`` (the last but one column is tx_text) with tx_decision instead of the text."""
    scorer = rows.sparkSession.sparkContext.broadcast(Scorer(machine))
    schema = rows.drop("tx_text").select("*", F.lit(0.0).alias("tx_decision")).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "tx_text"):
                rest = [part.column(c) for c in names[:-1]]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(scorer.value.texts(part.column("tx_text")))], names=names)

    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted, decision."""
    fitted = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("tx_text"))
    if fitted is None:
        out = rows.select("doc_id", F.lit(EMPTY).alias("tx_decision"), F.lit(0.0).alias("score"))
    else:
        machine, slope, constant = fitted
        out = _decisions(rows, machine).withColumn("score", 1 / (1 + F.exp(-(F.lit(slope) * F.col("tx_decision") + F.lit(constant)))))
    return out.select(
        "doc_id", (bucket(F.col("doc_id"), 0, FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("tx_decision").alias("decision")
    )

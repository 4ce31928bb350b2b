"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded down the tree.

Every element is one of three: above the article (a container that holds it), in the article, or outside (menus, headers, footers, sidebars,
notices, adverts, forms, code, comments).  Features of a node are its tag, the words of its class, id and role by family (its own, those
above and those below it), depth, and the size, density, links and punctuation of its subtree, against the page, its parent and its siblings.
One ensemble of boosted trees per class (Spark ML) gives log-odds.  Decoding takes the most likely labelling of the whole tree, like a
hidden Markov model on it: a node's log-probabilities plus, at half weight, the log-probability of its class given its parent's,
counted on the training pages.  Contradictions are ruled out: below an article element there is only article or outside,
below an outside element only outside.  It is one pass up and one down over all pages of a batch.

Training pages are a bounded sample (``SAMPLE``, the smallest keyed hashes of the html): a page with exactly one <article>, else one <main>, labels
itself, and its texts are set again in ``VARIANTS`` random layouts with known parts (layouts.py), so that the trees do not lean on that tag.

Defined results: null and empty html have an empty text and no characters; a page without an article has an empty text; bare text without
elements is an article if the trees say so; pages are read whole, whatever their length or depth, and markup that is broken or cut off is
closed at its end; white space is what Python's str.split takes for it, no-break spaces included; scripts, styles and head elements are
never text; repeated rows are treated alike; null ids stay null; where no page can be sampled (an empty table, or no page with text) nothing is
learned and texts are empty; other columns are not read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from .dom import BITS, CODE, HIDDEN, NAMES, Tree, parse
from .layouts import Layout
from .shared import prepare, stored
from .text import slices

#: Pages that are sampled, layouts of each, rounds and depth of the trees; nodes of all kinds that count into a kind's transitions, and
#: the weight of transitions beside the trees, which have seen a node's surroundings too.
SAMPLE, VARIANTS, ROUNDS, DEPTH, SMOOTH, STEP_WEIGHT = 240, 6, 20, 5, 20, 0.5
ABOVE, ARTICLE, OUTSIDE = 0, 1, 2
SLICE = 1 << 20

GROUPS = {
    "p": "p", "div": "div", "section": "section", "article": "article", "main": "main", "nav": "nav menu", "header": "header hgroup", "footer": "footer", "aside": "aside",
    "form": "form input select option optgroup button textarea label fieldset legend datalist output search", "list": "ul ol dl dir", "item": "li dt dd", "h1": "h1", "heading": "h2 h3 h4 h5 h6",
    "table": "table tr td th tbody thead tfoot caption", "quote": "blockquote pre figure figcaption address details summary", "body": "body", "root": "#page", "code": " ".join(sorted(CODE)), "ins": "ins a span dialog",
}
GROUP = {t: i for i, tags in enumerate(GROUPS.values()) for t in tags.split()}
OTHER = len(GROUPS)
FEATURES = 26 + len(GROUPS) + 4 * (len(NAMES) + 1) + 1
_P, _LI, _H, _FORM, _CODE = (list(GROUPS).index(g) for g in ("p", "item", "heading", "form", "code"))


class Nodes:
    """The nodes of several pages in one numbering, with their features."""

    def __init__(self, trees: list[Tree]):
        sizes = np.array([len(t.tag) for t in trees], np.int64)
        base = np.concatenate([[0], np.cumsum(sizes)])
        self.base, self.n = base, int(base[-1])
        self.page = np.repeat(np.arange(len(trees)), sizes)
        shift = base[:-1][self.page]
        parent = np.concatenate([np.array(t.parent, np.int64) for t in trees]) if trees else np.zeros(0, np.int64)
        self.top = parent < 0
        self.parent = np.where(self.top, np.arange(self.n), parent + shift)
        self.end = (np.concatenate([np.array(t.end, np.int64) for t in trees]) if trees else np.zeros(0, np.int64)) + shift
        self.group = np.array([GROUP.get(tag, OTHER) for t in trees for tag in t.tag], np.int64)
        self.bits = np.array([b for t in trees for b in t.bits], np.int64)
        self.tags = np.array([c for t in trees for c in t.tags], np.int64)
        depth, levels = np.zeros(self.n, np.int64), []
        level = np.flatnonzero(self.top)
        order = np.argsort(self.parent, kind="stable")
        order = order[~self.top[order]]
        first = np.searchsorted(self.parent[order], np.arange(self.n))
        last = np.searchsorted(self.parent[order], np.arange(self.n), "right")
        while len(level):
            levels.append(level)
            counts = last[level] - first[level]
            at = np.repeat(first[level] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            level = order[at]
            depth[level] = len(levels)
        self.depth, self.levels = depth, levels
        own = np.zeros((self.n, 5))
        code = self.group == _CODE
        for i, t in enumerate(trees):
            for node, text, _, link in t.pieces:
                v = base[i] + node
                if not code[v]:
                    words = text.split()
                    if words:
                        size = sum(map(len, words))
                        own[v] += (size, size if link else 0, sum(map(text.count, ".,;:!?")), len(words), "©" in text)
        self.own = own
        self.above = np.zeros(self.n, np.int64)
        for level in levels[1:]:
            p = self.parent[level]
            self.above[level] = self.above[p] | self.bits[p]

    def below(self, x: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        sums = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
        return sums[self.end] - sums[:-1]

    def features(self) -> np.ndarray:
        n, parent, page = self.n, self.parent, self.page
        if not n:
            return np.zeros((0, FEATURES))
        marks = np.column_stack([self.group == g for g in (_P, _LI, _H, _FORM)]).astype(float)
        in_p = self.own[:, :1] * (self.group == _P)[:, None]
        total = self.below(np.column_stack([self.own, np.ones(n), self.tags, marks, in_p]))
        chars, link, punct, words, sign, nodes, tags, p, li, h, form, p_chars = total.T
        whole = chars[self.base[:-1]][page]
        before = np.cumsum(self.own[:, 0]) - self.own[:, 0]
        before = before - before[self.base[:-1]][page]
        inner = ~self.top
        count = np.bincount(parent[inner], minlength=n)
        siblings = np.where(inner, count[parent], 1)
        largest = np.zeros(n)
        np.maximum.at(largest, parent[inner], chars[inner])
        kind = np.unique(np.column_stack([parent, self.group]), axis=0, return_inverse=True)[1].reshape(-1)
        alike = np.bincount(kind)[kind]
        order = np.zeros(n)
        inside = np.flatnonzero(inner)
        by = inside[np.argsort(parent[inside], kind="stable")]
        new = np.concatenate([[True], parent[by][1:] != parent[by][:-1]]) if len(by) else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0)) if len(by) else by
        order[by] = np.arange(len(by)) - start
        out = [
            np.log1p(chars), chars / np.maximum(whole, 1), np.log1p(self.own[:, 0]), link / np.maximum(chars, 1), self.own[:, 1] / np.maximum(self.own[:, 0], 1), punct / np.maximum(words, 1),
            chars / np.maximum(words, 1), np.log1p(words), np.log1p(nodes), np.log1p(chars / tags.clip(1)), self.depth, before / np.maximum(whole, 1), order / np.maximum(siblings - 1, 1), np.log1p(siblings),
            chars / np.maximum(chars[parent], 1), chars / np.maximum(np.where(inner, largest[parent], chars), 1), np.log1p(alike), np.log1p(p), p_chars / np.maximum(chars, 1), np.log1p(h), np.log1p(li),
            np.log1p(form), (link / np.maximum(chars, 1))[parent], np.log1p(chars[parent]), sign, np.log1p(whole),
        ]
        out += [self.group == g for g in range(len(GROUPS))]
        flags = [(self.bits >> i) & 1 for i in range(len(NAMES) + 1)]
        held = self.below(np.column_stack(flags).astype(float)) - np.column_stack(flags)
        out += [*flags, *[(self.above >> i) & 1 for i in range(len(NAMES) + 1)], *[(self.bits[parent] >> i) & 1 for i in range(len(NAMES) + 1)], *(np.minimum(held, 3).T)]
        out.append(self.group[parent] == _P)
        return np.column_stack(out).astype(float)

    def kinds(self) -> np.ndarray:
        """What a transition depends on: the tag's group, and whether the element's own names say anything."""
        return self.group * 2 + (self.bits > 0)

    def decode(self, unary: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """The class of each node: the labelling with the largest sum of ``unary`` (node, class) and of ``steps`` (node, class of its
        parent, class); -inf in ``steps`` rules a pair out."""
        best = unary.copy()
        for level in self.levels[:0:-1]:
            np.add.at(best, self.parent[level], (best[level, None, :] + steps[level]).max(axis=2))
        out = np.zeros(self.n, np.int64)
        for i, level in enumerate(self.levels):
            out[level] = (best[level] + (steps[level, out[self.parent[level]]] if i else 0)).argmax(axis=1)
        return out


def main_text(tree: Tree, keep: np.ndarray) -> str:
    """Text of the kept nodes, a space for white space and borders of blocks."""
    out: list[str] = []
    broken = False
    for node, text, new, _ in tree.pieces:
        broken = broken or new
        if keep[node]:
            out.append(" " + text if broken else text)
            broken = False
    return " ".join("".join(out).split())


# --- training pages -------------------------------------------------------------------------------------------


def truths(tree: Tree, marks: bool) -> np.ndarray | None:
    """Classes of a page that labels itself: by data-truth, or by its only <article> or <main>; None if it does not."""
    n = len(tree.tag)
    seat = None
    if not marks:
        for tag in ("article", "main"):
            if tree.tag.count(tag) == 1:
                seat = tree.tag.index(tag)
                break
        else:
            return None
    own = np.full(n, -1)
    for v in range(n):
        if tree.tag[v] in CODE or tree.truth[v] == "b" or not marks and (tree.tag[v] in ("nav", "footer", "aside", "form") or tree.bits[v] & (BITS["ad"] | BITS["comment"] | HIDDEN) and v != seat):
            own[v] = OUTSIDE
        elif tree.truth[v] == "c" or v == seat:
            own[v] = ARTICLE
    out = np.full(n, ABOVE)
    for v in range(n):
        above = out[tree.parent[v]] if v else ABOVE
        out[v] = OUTSIDE if above == OUTSIDE or own[v] == OUTSIDE else ARTICLE if above == ARTICLE or own[v] == ARTICLE else ABOVE
    holds = np.zeros(n, bool)
    for v in range(n - 1, -1, -1):
        holds[v] |= out[v] == ARTICLE
        if v and holds[v]:
            holds[tree.parent[v]] = True
    out[(out == ABOVE) & ~holds] = OUTSIDE
    return out


def blocks_of(tree: Tree, keep: np.ndarray) -> list[str]:
    found: list[list[str]] = []
    for node, text, new, _ in tree.pieces:
        if keep[node]:
            if new or not found:
                found.append([])
            found[-1].append(text)
    return [b for b in (" ".join("".join(f).split()) for f in found) if b]


def training_trees(page: str, variants: int) -> list[tuple[Tree, np.ndarray]]:
    """Labelled trees from one page: itself if it can, and its texts in other layouts."""
    tree = parse(page)
    known = truths(tree, False)
    code = np.array([t in CODE for t in tree.tag])
    blocks = blocks_of(tree, known == ARTICLE if known is not None else ~code)
    phrases = blocks_of(tree, known == OUTSIDE if known is not None else ~code) + blocks
    if not blocks:
        return []
    out = [(tree, known)] if known is not None else []
    rng = random.Random(page)
    for _ in range(variants):
        some = blocks[: rng.randint(1, len(blocks))] if rng.random() < 0.5 else rng.sample(blocks, rng.randint(1, min(len(blocks), 40)))
        if rng.random() < 0.5:  # some of the blocks become short ones
            some = [" ".join(b.split()[: rng.randint(1, 6)]) if rng.random() < 0.3 else b for b in some]
        set_again = parse(Layout(rng, phrases).page(rng.choice([some[0][:60], " ".join(rng.choice(phrases).split()[: rng.randint(1, 8)]), ""]), some))
        out.append((set_again, truths(set_again, True)))
    return out


def training_nodes(pages: DataFrame, html_col: str, sample: int, variants: int) -> DataFrame:
    """label, above (the parent's label), kind and features of the nodes of sampled pages."""
    prepare(pages.sparkSession)
    key = F.xxhash64(F.col("ar_html"), F.lit("article"))
    used = pages.select(F.col(f"`{html_col}`").cast("string").alias("ar_html")).filter("ar_html rlike '[^\\\\s]'")
    chosen = used.withColumn("ar_key", key).orderBy("ar_key", "ar_html").limit(sample).select("ar_html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column("ar_html").to_pylist():
                found = training_trees(page, variants)
                if not found:
                    continue
                nodes = Nodes([t for t, _ in found])
                x = nodes.features()
                y = np.concatenate([y for _, y in found])
                above = np.where(nodes.top, ABOVE, y[nodes.parent])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), pa.array(x.ravel()))
                small = [pa.array(v.astype(np.int32)) for v in (y, above, nodes.kinds())]
                yield pa.RecordBatch.from_arrays([*small, lists], names=["label", "above", "kind", "features"])

    return chosen.repartition(8).mapInArrow(run, "label int, above int, kind int, features array<double>")


# --- boosted trees --------------------------------------------------------------------------------------------

_SPLIT = re.compile(r"\s*If \(feature (\d+) <= ([-+.\dEe]+)\)")
_LEAF = re.compile(r"\s*Predict: ([-+.\dEe]+)")


class Ensembles:
    """Trees of all classes as arrays: feature, cut, left, right, value; a leaf points at itself."""

    def __init__(self) -> None:
        self.feature, self.cut, self.left, self.right, self.value = [], [], [], [], []
        self.roots: list[int] = []
        self.weight: list[float] = []
        self.of_class: list[int] = []
        self.counts = np.zeros((2 * (OTHER + 1), 3, 3))  # kind, parent's class, class

    def _node(self) -> int:
        i = len(self.value)
        for a, v in ((self.feature, 0), (self.cut, 0.0), (self.left, i), (self.right, i), (self.value, 0.0)):
            a.append(v)
        return i

    def add(self, described: str, weight: float, k: int) -> None:
        """A tree from Spark's description of it."""
        lines = iter([line for line in described.splitlines()[1:] if line.strip()])

        def read() -> int:
            i, line = self._node(), next(lines)
            split = _SPLIT.match(line)
            if split:
                self.feature[i], self.cut[i] = int(split[1]), float(split[2])
                self.left[i] = read()
                next(lines)  # the Else of the same split
                self.right[i] = read()
            else:
                self.value[i] = float(_LEAF.match(line)[1])
            return i

        self.roots.append(read())
        self.weight.append(weight)
        self.of_class.append(k)

    def done(self) -> Ensembles:
        for name in ("feature", "cut", "left", "right", "value", "roots", "weight", "of_class"):
            setattr(self, name, np.array(getattr(self, name)))
        return self

    def log_p(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of the three classes."""
        margin = np.zeros((len(x), 3))
        for low in range(0, len(x), 8192):
            part = x[low : low + 8192]
            at = np.repeat(self.roots[None, :], len(part), axis=0)
            rows = np.arange(len(part))[:, None]
            for _ in range(DEPTH):
                at = np.where(part[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            value = self.value[at] * self.weight
            for k in range(3):
                margin[low : low + 8192, k] = value[:, self.of_class == k].sum(axis=1)
        log_odds = -np.logaddexp(0, -2 * margin)
        return log_odds - np.logaddexp.reduce(log_odds, axis=1, keepdims=True)

    def article(self, nodes: Nodes) -> np.ndarray:
        """Which nodes are in the article."""
        seen = self.counts + SMOOTH * self.counts.sum(axis=0) / max(self.counts.sum(), 1) + 1e-3  # a kind that is rare leans on all kinds
        seen[:, ARTICLE, ABOVE] = seen[:, OUTSIDE, ABOVE] = seen[:, OUTSIDE, ARTICLE] = 0
        with np.errstate(divide="ignore"):
            steps = STEP_WEIGHT * np.log(seen / seen.sum(axis=2, keepdims=True))
        return (nodes.decode(self.log_p(nodes.features()), steps[nodes.kinds()]) == ARTICLE) & (nodes.group != _CODE)


def fit(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE, variants: int = VARIANTS) -> Ensembles | None:
    """Boosted trees for the three classes; None if no page gives both article and other nodes."""
    nodes = stored(training_nodes(pages, html_col, sample, variants), "nodes")
    seen = {r.label for r in nodes.select("label").distinct().collect()}
    if not {ARTICLE, OUTSIDE} <= seen:
        return None
    rows = stored(nodes.select("label", array_to_vector("features").alias("features")).coalesce(4), "vectors")
    out = Ensembles()
    for r in nodes.groupBy("kind", "above", "label").count().collect():
        out.counts[r.kind, r.above, r.label] = r["count"]
    for k in (ABOVE, ARTICLE, OUTSIDE):
        trainer = GBTClassifier(featuresCol="features", labelCol="y", maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, maxBins=32, minInstancesPerNode=3, seed=11)
        model = trainer.fit(rows.withColumn("y", (F.col("label") == k).cast("double")))
        for tree, weight in zip(model.trees, model.treeWeights, strict=True):
            out.add(tree.toDebugString, weight, k)
    return out.done()


def extracted(pages: DataFrame, model: Ensembles | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per page: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    prepare(spark)
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").cast("string").alias("ar_html"))
    if model is None:
        return rows.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars"))
    known = spark.sparkContext.broadcast(model)
    schema = rows.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ar_html", SLICE):
                trees = [parse(page or "") for page in part.column("ar_html").to_pylist()]
                nodes = Nodes(trees)
                keep = known.value.article(nodes)
                texts = [main_text(t, keep[nodes.base[i] : nodes.base[i + 1]]) for i, t in enumerate(trees)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``extracted`` with a model learned from ``pages``."""
    return extracted(pages, fit(pages, html_col), id_col, url_col, html_col)

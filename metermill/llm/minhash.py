"""Near-duplicate documents: one-permutation MinHash, optimal densification, banded buckets, star-shaped candidates.

One pass hashes the word shingles of every text.  ``BINS`` bins split the hash range and keep their smallest value; an
empty bin copies a filled one along a fixed random probe sequence (optimal densification).  Bands of ``ROWS`` bins
are bucket keys.  Texts with the same shingle set are one node from then on, so copies cost nothing.

In a bucket one member, the hub, is paired with the others: a star, not all pairs.  Pairs are confirmed on the full sets of
both texts.  Hubs are the members that share most buckets, so copies around one original settle at once.

A link can also join two members of a star that the hub does not reach.  Where a star is left with several components, its members meet
once more, by an exact prefix filter on their whole sets.  Shingles are ordered by how many of these members have them, rarest first.
Sets of a and b shingles (a <= b) with similarity t share t (a + b) / (1 + t) shingles or more, so they share one of their first few: for
the smaller one the first a - 2 t a / (1 + t) + 1, for the larger one hardly more if the sizes are near each other, which is why sizes
meet by classes.  An edited copy's own shingles are the rarest and fill these few places, so copies of one original do not meet each
other on what all of them have; and where two meet, the places at which they do bound what they can share.  Pairs that are left are
confirmed like the others.  No link between members of a bucket is lost, and nothing here grows with the square of a group of copies
that are edited apart.

Two sets with similarity 0.8 share a band with probability 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.999997.

Defined results: null texts, empty texts and texts without words have no shingles and are linked with nothing; a text
with fewer words than a shingle is one shingle; rows with a null id are linked with nothing, have a null component and are
kept; rows that repeat an id are one document; an empty table gives an empty table; other columns pass through ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .graph import components
from .shared import of_row, packed, prepare, stored, unpacked
from .text import U, Words, mixed, slices

BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
THRESHOLD = 80

_probes: list[np.ndarray] = []


def probe(t: int) -> np.ndarray:
    """The bin that each bin asks in its t-th attempt."""
    while len(_probes) <= t:
        _probes.append((mixed(np.arange(BINS, dtype=U) * U(0x10001) + U(len(_probes) + 1) * U(0x9E3779B1)) % U(BINS)).astype(np.int64))
    return _probes[t]


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(texts, lower=True)
    h = w.hashes()
    at, key = w.windows(k, h)
    ptr = np.searchsorted(at, w.ptr)
    out = []
    for i, n in enumerate(w.count()):
        if n >= k:
            out.append(np.unique(key[ptr[i] : ptr[i + 1]]))
        elif n:
            x = np.full(1, U(n))
            for j in range(w.ptr[i], w.ptr[i + 1]):
                x = mixed(x * U(31) + h[j])
            out.append(x)
        else:
            out.append(np.zeros(0, U))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Densified bins; the rows of empty sets have no meaning."""
    low = np.zeros((len(sets), BINS), U)
    filled = np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        if len(s):
            b = (((s >> U(32)) * U(BINS)) >> U(32)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            low[i, b[first]], filled[i, b[first]] = s[first], True
        else:
            filled[i] = True
    rows, bins = np.nonzero(~filled)
    t = 0
    while len(rows):
        ask = probe(t)[bins]
        ok = filled[rows, ask]
        low[rows[ok], bins[ok]] = low[rows[ok], ask[ok]]
        rows, bins, t = rows[~ok], bins[~ok], t + 1
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    key = np.broadcast_to(mixed(np.arange(BANDS, dtype=U) + U(11)), (len(low), BANDS)).copy()
    for j in range(ROWS):
        key = mixed(key * U(31) + low[:, j::ROWS])
    return key


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """mh_id, mh_n (shingles), mh_a and mh_b (128 bits of the set), mh_bands."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "mh_text"):
                sets = shingle_sets(part.column("mh_text"), shingle)
                keys = band_keys(signatures(sets)).view(np.int64)
                n = np.array([len(s) for s in sets], np.int64)
                a = np.array([s.sum(dtype=U) for s in sets], U).view(np.int64)
                b = np.array([np.bitwise_xor.reduce(mixed(s + U(3))) if len(s) else 0 for s in sets], U).view(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("mh_id"), pa.array(n), pa.array(a), pa.array(b), bands], names=["mh_id", "mh_n", "mh_a", "mh_b", "mh_bands"])

    used = docs.select(F.col(f"`{id_col}`").cast("long").alias("mh_id"), F.col(f"`{text_col}`").alias("mh_text"))
    return used.mapInArrow(run, "mh_id long, mh_n long, mh_a long, mh_b long, mh_bands array<long>")


def compared(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs (hub, node) with the sizes of their full shingle sets (n_hub, n_node) and of the intersection (inter)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_hub", 1 << 19):
                coded = pa.chunked_array([part.column("text_hub"), part.column("text_node")]).dictionary_encode()
                hub, node = (c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks)
                sets = shingle_sets(coded.chunks[-1].dictionary, shingle)
                sizes = np.array([len(s) for s in sets], np.int64)
                inter = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(hub, node, strict=True)], np.int64)
                cols = [part.column("hub"), part.column("node"), pa.array(sizes[hub]), pa.array(sizes[node]), pa.array(inter)]
                yield pa.RecordBatch.from_arrays(cols, names=["hub", "node", "n_hub", "n_node", "inter"])

    t_hub = texts.select(F.col("node").alias("hub"), F.col("mh_text").alias("text_hub"))
    t_node = texts.select("node", F.col("mh_text").alias("text_node"))
    rows = pairs.join(t_node, "node").join(t_hub, "hub").select("hub", "node", "text_hub", "text_node")
    return rows.mapInArrow(run, "hub long, node long, n_hub long, n_node long, inter long")


def _linked(rows: DataFrame, threshold: int) -> DataFrame:
    similar = 100 * F.col("inter") >= threshold * (F.col("n_hub") + F.col("n_node") - F.col("inter"))
    return rows.filter(similar).select(F.least("hub", "node").alias("u"), F.greatest("hub", "node").alias("v")).distinct()


def _members(sketch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes by set (node, mh_a, mh_b, mh_n), and the rows bucket, node, score of buckets with two members or more."""
    some = sketch.filter("mh_n > 0 and mh_id is not null")
    nodes = stored(some.groupBy("mh_a", "mh_b", "mh_n").agg(F.min("mh_id").alias("node"), F.min_by("mh_bands", "mh_id").alias("mh_bands")), "nodes")
    rows = nodes.select("node", F.explode("mh_bands").alias("bucket"))
    large = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("bucket", "size")
    members = stored(rows.join(large, "bucket").groupBy("bucket", "node").agg(F.min("size").alias("size")), "bucket_rows")
    score = members.groupBy("node").agg(F.sum("size").alias("score"))
    return nodes.drop("mh_bands"), stored(members.select("bucket", "node").join(score, "node"), "members")


def _relabelled(labels: DataFrame, new: DataFrame) -> DataFrame:
    """``labels`` (node, label) after the links ``new``."""
    if not new.limit(1).count():
        return labels
    u = labels.select(F.col("node").alias("u"), F.col("label").alias("lu"))
    v = labels.select(F.col("node").alias("v"), F.col("label").alias("lv"))
    moved = components(new.join(u, "u").join(v, "v").select(F.col("lu").alias("u"), F.col("lv").alias("v")))
    moved = moved.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return stored(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels", True)


def links(members: DataFrame, texts: DataFrame, shingle: int, threshold: int = THRESHOLD) -> DataFrame:
    """node and label (the smallest node of its component) of all members."""
    hubs = members.groupBy("bucket").agg(F.max_by("node", F.struct("score", F.negative("node"))).alias("hub"))
    pairs = stored(members.join(hubs, "bucket").filter("node <> hub").select("hub", "node").distinct(), "pairs", True)
    first = stored(compared(pairs, texts, shingle), "compared", True)
    labels = stored(members.select("node").distinct().withColumn("label", F.col("node")), "labels", True)
    labels = _relabelled(labels, stored(_linked(first, threshold), "links", True))

    # stars that are left with several components
    star = first.join(labels, "node").select("hub", "node", "label")
    several = star.groupBy("hub").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b").select("hub")
    left = stored(star.join(several, "hub").select("node").distinct().join(labels, "node"), "left", True)
    checked = pairs.select(F.least("hub", "node").alias("u"), F.greatest("hub", "node").alias("v"))
    more = stored(_candidates(left, texts, shingle, threshold).join(checked, ["u", "v"], "left_anti"), "candidates", True)
    found = _linked(compared(more.select(F.col("u").alias("hub"), F.col("v").alias("node")), texts, shingle), threshold)
    return _relabelled(labels, stored(found, "links", True))


#: Sizes of one class differ by this factor at most.
CLASS = 1.05


def _candidates(nodes: DataFrame, texts: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """u < v of all pairs of ``nodes`` (node, label) with different labels that can have the similarity: an exact prefix filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "mh_text"):
                sets = shingle_sets(part.column("mh_text"), shingle)
                n = np.array([len(s) for s in sets], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate([*sets, np.zeros(0, U)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(n), lists], names=["node", "n", "h"])

    def needed(a: str, b: str) -> str:
        """Shingles that sets of these sizes must share."""
        return f"ceil({threshold} * ({a} + {b}) / {100 + threshold}bd)"

    sets = texts.join(nodes.select("node"), "node", "left_semi").select("node", "mh_text").mapInArrow(run, "node long, n long, h array<long>")
    each = stored(sets.select("node", "n", F.explode("h").alias("h")), "shingles")
    shared = each.groupBy("h").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    of_node = Window.partitionBy("node")
    # a set's own shingles are in no other set and take the first places
    place = F.row_number().over(of_node.orderBy("times", "h")) + F.col("n") - F.count(F.lit(1)).over(of_node)
    rows = each.join(shared, "h").withColumn("place", place).filter(f"place <= n - ceil({threshold} * n / 100bd) + 1")
    size_class = f"cast(floor(ln({{}}) / ln({CLASS}d)) as int)"
    rows = stored(rows.join(nodes, "node").select("h", "node", "label", "n", "place"), "prefixes")
    smaller = rows.filter(f"place <= n - {needed('n', 'n')} + 1").withColumn("class", F.expr(size_class.format("n")))
    least = f"ceil({threshold} * n / 100bd)"
    larger = rows.withColumn("class", F.explode(F.expr(f"sequence({size_class.format(least)}, {size_class.format('n')})")))
    larger = larger.filter(f"place <= n - {needed(f'greatest({least}, floor(pow({CLASS}d, class)))', 'n')} + 1")
    smaller = smaller.select("h", "class", *[F.col(c).alias(f"{c}_a") for c in ("node", "label", "n", "place")])
    larger = larger.select("h", "class", *[F.col(c).alias(f"{c}_b") for c in ("node", "label", "n", "place")])
    # what two sets can share from the place on at which they meet first
    reach = f"1 + least(n_a - place_a, n_b - place_b) >= {needed('n_a', 'n_b')}"
    meet = smaller.join(larger, ["h", "class"]).filter("label_a <> label_b and (n_a < n_b or n_a = n_b and node_a < node_b)").filter(f"100 * n_a >= {threshold} * n_b").filter(reach)
    return meet.select(F.least("node_a", "node_b").alias("u"), F.greatest("node_a", "node_b").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept."""
    sketch = stored(sketches(docs, id_col, text_col, shingle), "sketches")
    nodes, members = _members(sketch)
    wanted = members.select("node").distinct().hint("merge")  # the same join at every size: what is shuffled grows with the input
    texts = stored(docs.select(F.col(f"`{id_col}`").cast("long").alias("node"), F.col(f"`{text_col}`").alias("mh_text")).join(wanted, "node", "left_semi"), "texts")
    labels = links(members, texts, shingle, threshold)
    nodes = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = sketch.drop("mh_bands").join(nodes.select("mh_a", "mh_b", "mh_n", "label"), ["mh_a", "mh_b", "mh_n"], "left")
    component = F.when(F.col("mh_id").isNotNull(), F.coalesce("label", "mh_id"))
    return rows.select(F.col("mh_id").alias("doc_id"), F.col("mh_n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("mh_id"), F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """The documents that stay: of each component the one with the smallest id."""
    gone = stored(near_duplicates(docs, id_col, text_col, shingle, threshold).filter("not kept").select(F.col("doc_id").alias("mh_gone")).distinct(), "gone")
    return unpacked(packed(docs).join(gone, of_row(id_col) == F.col("mh_gone"), "left_anti"), docs.columns)

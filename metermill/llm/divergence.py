"""Source divergence audit: how far the word shares of each source of a language are from its other sources and from the whole.

Terms are runs of ASCII letters and of anything beyond ASCII; A-Z become small.  Each language keeps the terms of at least
``MIN_DOCS`` of its documents.  A group (a source of a language, or the language) gives a kept term p = 1 + floor(10^9 (count + 1) /
(N + V)): V kept terms, N their occurrences in the group.  f = floor((p - q)^2 / q) weighs p against a reference q.

Terms (``part`` = term) are ranked through count cells.  All terms of a group with the same count there and the same count in the
language have the same f, so f is worked out per cell (group count, language count), cells of one value merge, and the values' running
multiplicities say which of them reach the first ``TOP`` ranks.  Only terms of those cells are joined back and numbered in UTF-8 order.
Values per group are cut to ``TOP`` before the window, and terms per value likewise, so a window never holds a whole vocabulary.

Sources (``part`` = pair) are summed term by term in blocks of a dense matrix term x source.  Terms are dealt over parts by hash; the
table of groups goes to each part through the same shuffle, so nothing passes through the driver and no term emits pairs of its
sources.  A task holds the matrix of sums of one language, as large as that language's share of the result.

All arithmetic is exact: longs, with p by long division in three steps of 1,000 (exact up to 9 * 10^15 tokens in a group).

Defined results: null text, language and source count as ''; a group whose texts have no terms still gets its ranks of other
sources; a language without kept terms has value 0 for all pairs and no term rows; a source alone in its language has no pair
rows; texts of any length are taken whole; ties go by UTF-8 order of the item; repeated rows count as documents of their own; an
empty table gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import prepare, stored
from .text import LOWER, as_array, flat, slices

MIN_DOCS, TOP, UNIT = 3, 200, 1_000_000_000
#: Bytes of text that a task counts at once (a longer text at once, too), cells of a block of the dense matrix, rows of a result batch, kept
#: rows of a part that sums sources.
CHUNK, CELLS, ROWS, PART_ROWS = 8 << 20, 1 << 20, 50_000, 250_000

#: Bytes of terms: ASCII letters, and all bytes of characters beyond ASCII.
TERM = np.zeros(256, bool)
TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _counted(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """lang, source, term, n, docs of these rows."""
    rows = pa.Table.from_batches(parts).combine_chunks()
    lang, source = (as_array(rows.column(c)).dictionary_encode() for c in ("lang", "source"))
    group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    groups, group = np.unique(group, return_inverse=True)
    data, offs = flat(as_array(rows.column("text")))
    inside = TERM[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offs[:-1][offs[:-1] < len(data)]
    first[heads] |= inside[heads]
    starts = np.flatnonzero(first)
    ends = np.concatenate([[0], np.cumsum(inside)])
    ends = np.append(ends[starts], ends[-1])
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(LOWER[data[inside]])).dictionary_encode()
    doc = np.searchsorted(offs, starts, "right") - 1
    key = terms.indices.to_numpy().astype(np.int64) * len(groups) + group[doc]
    both = np.sort(key * max(rows.num_rows, 1) + doc)  # term, group, document
    key = both // max(rows.num_rows, 1)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
    n = np.diff(np.append(at, len(key)))
    new = np.concatenate([[True], both[1:] != both[:-1]]) if len(key) else np.zeros(0, bool)
    docs = np.add.reduceat(new.astype(np.int64), at) if len(at) else n
    of = groups[key[at] % len(groups)] if len(at) else key
    term = terms.dictionary.take(pa.array(key[at] // max(len(groups), 1))).cast(pa.string())
    columns = [lang.dictionary.take(pa.array(of // max(len(source.dictionary), 1))), source.dictionary.take(pa.array(of % max(len(source.dictionary), 1))), term, pa.array(n), pa.array(docs)]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def _texts(docs: DataFrame, *columns: tuple[str, str]) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in columns])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for rows in slices(batch, "text", CHUNK):
                held.append(rows)
                size += rows.column("text").nbytes
                if size >= CHUNK:
                    yield _counted(held)
                    held, size = [], 0
        if held:
            yield _counted(held)

    parts = _texts(docs, (lang_col, "lang"), (source_col, "source"), (text_col, "text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_docs: int) -> DataFrame:
    """lang, source, term, n, n_lang and first (true for one source of each term), of the terms that their language keeps."""
    of_term = Window.partitionBy("lang", "term")
    rows = counts.withColumns(
        {"n_lang": F.sum("n").over(of_term), "in_docs": F.sum("docs").over(of_term), "first": F.col("source") == F.min("source").over(of_term)}
    )
    return rows.filter(F.col("in_docs") >= min_docs).drop("docs", "in_docs")


def groups_of(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """``groups`` (lang, source) with total (N), lang_total and terms (V)."""
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("long")).alias("firsts"))
    whole = Window.partitionBy("lang")
    zero = F.coalesce("total", F.lit(0))
    rows = groups.join(sums, ["lang", "source"], "left")
    return rows.select("lang", "source", zero.alias("total"), F.sum(zero).over(whole).alias("lang_total"), F.coalesce(F.sum("firsts").over(whole), F.lit(0)).alias("terms"))


def share(n: str, total: str) -> Column:
    """p of a count in a group of so many kept occurrences; inside, decimals: the product passes the range of a long."""
    return F.expr(f"1 + cast({n} + 1 as decimal(20, 0)) * {UNIT} div cast({total} + terms as decimal(20, 0))")


def weight(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def top_terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """lang, source, item, value, rank of the terms that a group uses more than its language does."""
    group = ["lang", "source"]
    cells = kept.groupBy(*group, "n", "n_lang").agg(F.count(F.lit(1)).alias("times")).join(groups, group)
    cells = cells.withColumns({"p": share("n", "total"), "q": share("n_lang", "lang_total")}).filter("p > q").withColumn("value", weight("p", "q"))
    cells = stored(cells.select(*group, "n", "n_lang", "times", "value"), "cells")
    falling = Window.partitionBy(*group).orderBy(F.desc("value"))
    values = cells.groupBy(*group, "value").agg(F.sum("times").alias("times"))
    values = values.withColumn("place", F.row_number().over(falling)).filter(F.col("place") <= top)
    above = F.coalesce(F.sum("times").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("above", above).filter(F.col("above") < top).select(*group, "value", "above")
    reached = cells.join(values, [*group, "value"]).select(*group, "n", "n_lang", "value", "above")
    rows = kept.join(reached, [*group, "n", "n_lang"])
    by_item = Window.partitionBy(*group, "value").orderBy("term")
    rows = rows.withColumn("inside", F.row_number().over(by_item)).filter(F.col("inside") <= top)
    rank = (F.col("above") + F.col("inside")).cast("int")
    return rows.select(*group, F.col("term").alias("item"), "value", rank.alias("rank")).filter(F.col("rank") <= top)


class _Sums:
    """Sums of f over the terms of one part of a language, for all ordered pairs of its sources."""

    def __init__(self, lang: str):
        self.lang, self.sources, self.totals, self.terms = lang, [], [], 0
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # which term (rising), source, count
        self.last, self.next, self.seen = None, 0, False
        self.place: dict[str, int] | None = None

    def group(self, source: str, total: int, terms: int) -> None:
        self.sources.append(source)
        self.totals.append(total)
        self.terms = terms

    def start(self) -> None:
        if self.place is None:
            self.place = {s: i for i, s in enumerate(self.sources)}
            self.over = np.array(self.totals, np.int64) + self.terms
            self.sums = np.zeros((len(self.sources), len(self.sources)), np.int64)

    def rows(self, term: pa.Array, source: pa.Array, n: np.ndarray) -> None:
        """Rows in the order of their terms; those of one term may come in several calls."""
        self.start()
        code = term.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new = np.concatenate([[term[0].as_py() != self.last], code[1:] != code[:-1]])
        at = self.next - 1 + np.cumsum(new)
        self.last, self.next, self.seen = term[-1].as_py(), int(at[-1]) + 1, True
        coded = source.dictionary_encode()
        to = np.array([self.place[s] for s in coded.dictionary.to_pylist()], np.int64)
        self.waiting.append((at, to[coded.indices.to_numpy(zero_copy_only=False)], n))
        if self.next * len(self.sources) >= CELLS:
            self.add(self.next - 1)

    def add(self, before: int) -> None:
        """Take the terms below ``before`` into the sums; the last one may still go on."""
        if not self.waiting:
            return
        at, source, n = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        for low in range(0, before, max(1, CELLS // len(self.sources))):
            high = min(before, low + max(1, CELLS // len(self.sources)))
            some = slice(*np.searchsorted(at, [low, high]))
            counts = np.zeros((high - low, len(self.sources)), np.int64)
            counts[at[some] - low, source[some]] = n[some]
            p = self.shares(counts)
            for i in range(len(self.sources)):
                away = p[:, i : i + 1] - p
                self.sums[i] += (away * away // p).sum(axis=0)
        left = at >= before
        self.waiting = [(at[left] - before, source[left], n[left])]
        self.next -= before

    def shares(self, counts: np.ndarray) -> np.ndarray:
        rest, p = counts + 1, np.ones_like(counts)
        whole, rest = rest // self.over, rest % self.over
        for _ in range(3):  # three steps of 1,000, so that no product passes the range
            rest = rest * 1000
            whole, rest = whole * 1000 + rest // self.over, rest % self.over
        return p + whole

    def result(self, always: bool) -> Iterator[pa.RecordBatch]:
        self.start()
        self.add(self.next)
        if not (self.seen or always) or len(self.sources) < 2:
            return
        block = max(1, ROWS // len(self.sources))
        for low in range(0, len(self.sources), block):
            pairs = [(i, j) for i in range(low, min(low + block, len(self.sources))) for j in range(len(self.sources)) if i != j]
            if not pairs:
                continue
            i, j = np.array(pairs).T
            names = pa.array(self.sources, pa.string())
            columns = [pa.array([self.lang] * len(pairs), pa.string()), names.take(pa.array(i)), names.take(pa.array(j)), pa.array(self.sums[i, j])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "item", "value"])


def source_pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value (f summed over the language's kept terms)."""
    prepare(kept.sparkSession)
    parts = 1 + kept.count() // PART_ROWS  # from the stored table's footers: what the parts hand on grows with the rows, not with the cluster
    dealt = groups.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "lang", F.lit("").alias("term"), "source", F.col("total").alias("n"), "terms")
    dealt = dealt.unionByName(kept.select(F.pmod(F.xxhash64("lang", "term"), F.lit(parts)).cast("int").alias("part"), "lang", "term", "source", "n", F.lit(0).cast("long").alias("terms")))
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "lang", "term", "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, None
        for batch in batches:
            part, lang = batch.column("part").to_numpy(), batch.column("lang")
            code = lang.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((part[1:] != part[:-1]) | (code[1:] != code[:-1])) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                key = (int(part[low]), lang[low].as_py())
                if key != at:
                    if sums is not None:
                        yield from sums.result(at[0] == 0)
                    at, sums = key, _Sums(key[1])
                rows = batch.slice(low, high - low)
                term, source, n = rows.column("term"), rows.column("source"), rows.column("n").to_numpy()
                groups_here = int(pa.compute.sum(pa.compute.equal(term, "")).as_py())
                for s, total, terms in zip(source[:groups_here].to_pylist(), n[:groups_here].tolist(), rows.column("terms")[:groups_here].to_pylist(), strict=True):
                    sums.group(s, total, terms)
                if groups_here < len(n):
                    sums.rows(term[groups_here:], source[groups_here:], n[groups_here:])
        if sums is not None:
            yield from sums.result(at[0] == 0)

    sums = dealt.mapInArrow(run, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    kept = stored(kept_terms(term_counts(docs, text_col, lang_col, source_col), min_docs), "kept")
    groups = stored(groups_of(_texts(docs, (lang_col, "lang"), (source_col, "source")).distinct(), kept), "groups", True)
    pairs = source_pairs(kept, groups)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(top_terms(kept, groups, top).withColumn("part", F.lit("term")).select(*columns))


ORACLE = """
with d as (select row_number() over () as rid, coalesce(text, '') as t, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
words as (select rid, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{80}-\\x{10FFFF}]+')) as term from d),
c as (select lang, source, term, count(*) as n, count(distinct rid) as docs from words group by all),
k as (select lang, term, sum(n)::hugeint as n_lang from c group by all having sum(docs) >= 3),
g as (select distinct lang, source from d),
v as (select lang, count(*)::hugeint as terms, sum(n_lang)::hugeint as lang_total from k group by all),
rows_ as (select g.lang, g.source, k.term, coalesce(c.n, 0)::hugeint as n, k.n_lang from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
totals as (select lang, source, sum(n)::hugeint as total from rows_ group by all),
shares as (select r.lang, r.source, r.term, r.n, 1 + (1000000000 * (r.n + 1)) // (t.total + v.terms) as p, 1 + (1000000000 * (r.n_lang + 1)) // (v.lang_total + v.terms) as q
           from rows_ r join totals t using (lang, source) join v using (lang)),
pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
all_pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(p.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
              left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source),
terms_ as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // q)::bigint as value from shares where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from all_pairs union all select * from terms_))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 200
"""

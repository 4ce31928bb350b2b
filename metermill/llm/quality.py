"""Quality rules: a learned decision list over text statistics.

Statistics of every whole text come from one pass of Arrow batches.  Labelled rows (a sample bounded by ``SAMPLE``, the
smallest keyed hashes of doc_id) train an ordered list of rules by sequential covering: a rule grows by adding the
threshold with the largest information gain until it covers no good document, is pruned on rows it has not seen, joins
the list if it stays precise there, and its documents leave.  The list becomes one ordered Spark CASE expression.

Defined results: null and empty texts have zero statistics and fail the base rule; without labels of both kinds the list
is empty and only the base rule decides; documents with unknown labels are judged like all others; repeated rows are
judged alike; an empty table gives an empty table; other columns pass through ``keep`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import packed, prepare, stored, unpacked
from .text import Words, joint_codes, repeated, slices, span_codes

#: Most labelled rows that a list is learned from.
SAMPLE = 20_000
#: A rule joins the list if at least this share of what it covers among unseen rows is bad, of at least so many rows.
PRECISION, COVER = 0.97, 3
RULES, CONDITIONS, CUTS = 12, 4, 48

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_bars"]
#: Ratios that rules may test, as SQL over the counts.
RATIOS = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "symbols_per_char": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "upper_per_char": "n_upper / greatest(word_chars, 1)",
    "digits_per_char": "n_digits / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "bars_per_word": "n_bars / greatest(n_words, 1)",
}
BASE_FAILED = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"


def _marks(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


SYMBOLS, UPPER, DIGITS, EXCLAIM, BAR = _marks("#*$%&|<>"), _marks("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _marks("0123456789"), _marks("!?"), _marks("|")


def count_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text."""
    w = Words(texts)
    texts_n, n_words = len(w.ptr) - 1, w.count()
    of, starts, ends = w.lines()
    again = np.zeros(texts_n, np.int64)
    if len(of):
        line = joint_codes([span_codes(w.data, starts, ends)[0], of])
        order = np.argsort(line, kind="stable")
        later = order[1:][line[order][1:] == line[order][:-1]]
        again = np.bincount(of[later], minlength=texts_n)
    at, word = w.window_starts(3), w.codes()
    covered = np.zeros(len(w) + 3, np.int64)
    hit = at[repeated(joint_codes([word[at], word[at + 1], word[at + 2], w.text_of_word()[at]]))] if len(at) else at
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + 3, -1)
    inside = np.cumsum(covered)[: len(w)] > 0
    sums = np.concatenate([[0], np.cumsum(inside)])
    return {
        "n_words": n_words,
        "word_chars": w.per_text(w.inside & ((w.data & 0xC0) != 0x80)),
        "n_symbols": w.per_text(SYMBOLS[w.data]),
        "n_dup_lines": again,
        "n_repeat_words": sums[w.ptr[1:]] - sums[w.ptr[:-1]],
        "n_lines": np.bincount(of, minlength=texts_n),
        "n_upper": w.per_text(UPPER[w.data]),
        "n_digits": w.per_text(DIGITS[w.data]),
        "n_marks": w.per_text(EXCLAIM[w.data]),
        "n_bars": w.per_text(BAR[w.data]),
    }


def with_stats(rows: DataFrame, text_col: str | None = None) -> DataFrame:
    """``rows`` has ``row``, a struct with ``text_col``, or another column and ``stat_text``; result: the first column and the counts as
    stat_ columns."""
    prepare(rows.sparkSession)
    schema = rows.drop("stat_text").select("*", *[F.lit(0).cast("long").alias(f"stat_{c}") for c in COUNTS]).schema
    place = rows.schema["row"].dataType.names.index(text_col) if text_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("stat_text") if place is None else batch.column("row").field(place)
            for part in slices(pa.RecordBatch.from_arrays([batch.column(0), texts], names=["first", "stat_text"]), "stat_text"):
                counts = count_stats(part.column("stat_text"))
                cols = [part.column(0)] + [pa.array(np.asarray(counts[c], np.int64)) for c in COUNTS]
                yield pa.RecordBatch.from_arrays(cols, names=[batch.schema.names[0]] + [f"stat_{c}" for c in COUNTS])

    return rows.mapInArrow(run, schema)


# --- learning -------------------------------------------------------------------------------------------------

Condition = tuple[str, str, float]  # ratio, "<=" or ">", threshold


def _holds(x: dict[str, np.ndarray], rule: list[Condition]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for name, sign, cut in rule:
        out &= x[name] <= cut if sign == "<=" else x[name] > cut
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < CONDITIONS and (inside & ~bad).any():
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        best, gain = None, 1e-9
        for name, values in x.items():
            points = np.unique(values[inside])
            if len(points) < 2:
                continue
            cuts = np.unique(np.quantile((points[1:] + points[:-1]) / 2, np.linspace(0, 1, CUTS)))
            order = np.sort(values[inside & bad]), np.sort(values[inside & ~bad])
            low_p, low_n = np.searchsorted(order[0], cuts, "right"), np.searchsorted(order[1], cuts, "right")
            for sign, pp, nn in (("<=", low_p, low_n), (">", p - low_p, n - low_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - np.log2(p / (p + n))), -1)
                i = int(np.argmax(g))
                if g[i] > gain:
                    best, gain = (name, sign, float(f"{cuts[i]:.6g}")), g[i]
        if best is None:
            break
        rule.append(best)
        inside &= _holds(x, [best])
    return rule


def _prune(rule: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """The shortest head of the rule with the best (p - n) / (p + n) on rows it has not seen."""
    best, worth = rule, -2.0
    for k in range(len(rule), 0, -1):
        inside = _holds(x, rule[:k])
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        v = (p - n) / (p + n) if p + n else -1.0
        if v >= worth:
            best, worth = rule[:k], v
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray) -> list[list[Condition]]:
    """Ordered rules whose documents are bad; rows with ``fold`` true grow, the others prune and accept."""
    rules: list[list[Condition]] = []
    left = np.ones(len(bad), bool)
    while len(rules) < RULES and (left & fold & bad).sum() >= COVER:
        grow, test = left & fold, left & ~fold
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow])
        if not rule:
            break
        rule = _prune(rule, {k: v[test] for k, v in x.items()}, bad[test])
        inside = _holds(x, rule) & left
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        tp, tn = (inside & test & bad).sum(), (inside & test & ~bad).sum()
        if p < COVER or p < PRECISION * (p + n) or tp < PRECISION * (tp + tn):
            break
        rules.append(rule)
        left &= ~inside
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The ordered list as one conditional expression over stat_ columns: true where the document stays."""
    if not rules:
        return F.lit(True)
    out = None
    for rule in rules:
        test = " and ".join(f"({RATIOS[name]} {sign} {cut!r}D)" for name, sign, cut in rule)
        when = F.expr(_stat(test))
        out = F.when(when, F.lit(False)) if out is None else out.when(when, F.lit(False))
    return out.otherwise(F.lit(True))


def _stat(sql: str) -> str:
    for c in sorted(COUNTS, key=len, reverse=True):
        sql = sql.replace(c, f"stat_{c}")
    return sql


def id_stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A stored row per document: stat_id and the counts."""
    return stored(with_stats(docs.select(F.col(f"`{id_col}`").alias("stat_id"), F.col(f"`{text_col}`").alias("stat_text"))), "stats")


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Condition]]:
    """Rules from the labelled rows of ``stats`` (stat_id and counts); ``labels`` has doc_id and quality."""
    q = labels.filter(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("stat_id")).agg(F.min("quality").alias("stat_quality"))
    rows = (
        stats.select("stat_id", *[F.expr(_stat(sql)).cast("double").alias(name) for name, sql in RATIOS.items()], "stat_n_words")
        .filter("stat_n_words > 0").join(q, "stat_id").withColumn("stat_order", F.xxhash64("stat_id", F.lit("quality")))
        .orderBy("stat_order", "stat_id", *RATIOS).limit(sample).toPandas()
    )
    if not len(rows):
        return []
    x = {name: rows[name].to_numpy() for name in RATIOS}
    fold = (rows["stat_order"].to_numpy() % 3) != 0
    return learn(x, (rows["stat_quality"] == 0).to_numpy(), fold)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, the base counts, base_failed, kept."""
    stats = id_stats(docs, id_col, text_col)
    rules = fit(stats, labels)
    failed = F.expr(_stat(BASE_FAILED))
    return stats.select(F.col("stat_id").alias("doc_id"), *[F.col(f"stat_{c}").alias(c) for c in COUNTS[:5]], failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, as they came."""
    rules = fit(id_stats(docs, id_col, text_col), labels)
    stays = ~F.expr(_stat(BASE_FAILED)) & verdict(rules)
    return unpacked(with_stats(packed(docs), text_col).filter(stays), docs.columns)

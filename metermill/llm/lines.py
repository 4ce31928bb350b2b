"""Line dedup by distinct-site spread.

A line's spread is the number of distinct sites (sources) whose documents hold it.  One HyperLogLog sketch per line hash,
merged by ordinary aggregation, estimates the spreads.  Lines whose estimate is far above the threshold are
boilerplate; those near it get an exact distinct count.  Boilerplate stays only in the document with the smallest id that
has it and goes from all others.

Lines are what newlines separate.  Only lines of ``MIN_WORDS`` words or more are looked at.

Defined results: a null text stays null and an empty one empty; a null source is a site of its own; null ids come last
when the keeper is picked, and where all ids are null every document keeps the line; repeated rows are treated alike; an
empty table gives an empty table; other columns pass through ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import of_row, packed, stored, unpacked, word_count

#: Distinct sites from which on a line is boilerplate, and the fewest words of a line that counts.
MIN_SITES, MIN_WORDS = 5, 3
#: log2 of a sketch's registers; its relative standard error is 1.04 / sqrt(2 ** LG_K).
LG_K = 10
#: Standard errors on both sides of the threshold inside which the exact count decides (and one site at least).
BAND = 6


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits of a line, as two longs."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _exploded(docs: DataFrame, id_col: str, text_col: str, source_col: str, min_words: int) -> DataFrame:
    d = docs.select(F.col(f"`{id_col}`").alias("ln_id"), F.col(f"`{source_col}`").alias("ln_site"), _text_key(F.col(f"`{text_col}`")).alias("ln_text"), F.explode(_lines(F.col(f"`{text_col}`"))).alias("ln_line"))
    site = F.when(F.col("ln_site").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("ln_site")))
    return d.filter(word_count(F.col("ln_line")) >= min_words).select("ln_id", site.alias("ln_site"), "ln_text", _key(F.col("ln_line")).alias("ln_key"))


def _text_key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("text"), text).alias("b"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """ln_key and ln_keeper (the smallest id that has it) of the lines on ``min_sites`` sites or more."""
    sketched = lines.groupBy("ln_key").agg(F.hll_sketch_agg("ln_site", F.lit(lg_k)).alias("sketch"), F.min("ln_id").alias("ln_keeper"))
    band = max(1.0, BAND * 1.04 / (2 ** (lg_k / 2)) * min_sites)
    spread = stored(
        sketched.withColumn("spread", F.hll_sketch_estimate("sketch")).filter(F.col("spread") >= min_sites - band).select("ln_key", "ln_keeper", "spread"), "spread"
    )
    near = spread.filter(F.col("spread") <= min_sites + band)
    exact = (
        lines.join(near.select("ln_key"), "ln_key", "left_semi").groupBy("ln_key", "ln_site").agg(F.lit(1).alias("one"))
        .groupBy("ln_key").agg(F.count("one").alias("sites")).filter(F.col("sites") >= min_sites)
    )
    far = spread.filter(F.col("spread") > min_sites + band).select("ln_key", "ln_keeper")
    return stored(far.unionByName(near.join(exact, "ln_key").select("ln_key", "ln_keeper")), "boilerplate")


def _with_gone(docs: DataFrame, id_col: str, text_col: str, source_col: str, min_sites: int, min_words: int) -> DataFrame:
    """``row`` and ln_gone: the keys of the lines that leave each document (null: none)."""
    lines = _exploded(docs, id_col, text_col, source_col, min_words)
    found = boilerplate(lines, min_sites)
    gone = (
        lines.select("ln_id", "ln_text", "ln_key").join(found, "ln_key").filter(~F.col("ln_id").eqNullSafe(F.col("ln_keeper")))
        .groupBy("ln_id", "ln_text").agg(F.collect_set("ln_key").alias("ln_gone"))
        .withColumnsRenamed({"ln_id": "ln_gone_id", "ln_text": "ln_gone_text"})
    )
    d = packed(docs).withColumns({"ln_text": _text_key(of_row(text_col)), "ln_id": of_row(id_col)})
    return d.join(stored(gone, "gone"), F.col("ln_id").eqNullSafe(F.col("ln_gone_id")) & (F.col("ln_text") == F.col("ln_gone_text")), "left")


def _stay(text_col: str) -> Column:
    """The lines of a document that stay (null for a null text)."""
    every = _lines(of_row(text_col))
    return F.when(F.col("ln_gone").isNull(), every).otherwise(F.filter(every, lambda x: ~F.array_contains(F.col("ln_gone"), _key(x))))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per document: doc_id, lines before and after, words after, and the MD5 of the cleaned text."""
    d = _with_gone(docs, id_col, text_col, source_col, min_sites, min_words)
    d = d.select(F.col("ln_id").alias("doc_id"), F.greatest(F.size(_lines(of_row(text_col))), F.lit(0)).cast("long").alias("n_lines"), _stay(text_col).alias("stay"))
    rest = F.array_join("stay", "\n")
    return d.select("doc_id", "n_lines", F.greatest(F.size("stay"), F.lit(0)).cast("long").alias("n_kept"), word_count(rest).alias("n_words"), F.md5(rest.cast("binary")).alias("text_md5"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, drop_emptied: bool = False) -> DataFrame:
    """The documents with their texts cleaned; ``drop_emptied`` leaves out those that consisted of boilerplate alone."""
    d = _with_gone(docs, id_col, text_col, source_col, min_sites, min_words).withColumn("ln_rest", F.array_join(_stay(text_col), "\n"))
    if drop_emptied:
        d = d.filter(F.col("ln_gone").isNull() | F.coalesce(word_count(F.col("ln_rest")) > 0, F.lit(False)))
    return unpacked(d, docs.columns, **{text_col: F.col("ln_rest")})


#: The same rows as ``report`` of the documents table.
ORACLE = f"""
with d as (select row_number() over () as r, doc_id, text, coalesce('1' || source, '0') as site from documents),
lines as (select r, doc_id, site, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from d),
counted as (select *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= {MIN_WORDS} as long_enough from lines),
spread as (select line, min(doc_id) as keeper from counted where long_enough group by line having count(distinct site) >= {MIN_SITES}),
marked as (select c.*, s.line is not null and c.doc_id is distinct from s.keeper as gone from counted c left join spread s on c.long_enough and c.line = s.line),
rest as (select r, count(*) filter (not gone) as n_kept, coalesce(string_agg(line, chr(10) order by i) filter (not gone), '') as clean from marked group by r)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::bigint as n_lines, coalesce(n_kept, 0)::bigint as n_kept,
       coalesce(len(regexp_extract_all(clean, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as n_words, case when d.text is null then null else md5(clean) end as text_md5
from d left join rest using (r)
"""

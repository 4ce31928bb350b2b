"""From raw documents to token ids: quality rules, line dedup, near-duplicates, source mix, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  ``run`` stores what a stage returns in the
shared folder and reads it again, so a lost executor costs at most the stage at work.

For all stages: an empty table gives an empty table; texts of any length are taken whole; other columns pass through whatever
their names, but for the last stage, which returns its own. Rows that repeat are treated alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from metermill.llm import lines, minhash, mixing, pieces, quality
from metermill.llm.queries import documents, tokenizer
from metermill.llm.shared import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the learned decision list go.

    Null and empty texts fail the base rule; a null id is judged like any other; without labels of both kinds the base rule decides alone.
    """
    return quality.keep(docs, documents(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites stay in one document only; a document that was nothing else goes.

    A null source is a site of its own; the keeper is the smallest id, null ids come last; a null text stays null.  n_chars follows the text.
    """
    clean = lines.clean(docs, drop_emptied=True)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest id stays.

    Texts that are null or have no words are nobody's duplicates; rows without an id stay.
    """
    return minhash.dedup(docs, shingle=5)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target of words says: not at all, once or twice.

    A null source is a source of its own, the last; a text without words keeps one copy; ties go by a keyed hash of the id.
    """
    return mixing.mix(docs)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether they decode to the text again: doc_id, lang, source, n_pieces, ids, same; all other columns go.

    A null text has null ids, 0 pieces and a null ``same``; an empty one no ids.
    """
    rows = pieces.encoded(docs.select("doc_id", "lang", "source", "text"), tokenizer("piece_bpe_32k.model"))
    return rows.select("doc_id", "lang", "source", F.greatest(F.size("sp_ids"), F.lit(0)).cast("long").alias("n_pieces"), F.col("sp_ids").alias("ids"), F.col("sp_same").alias("same"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", source_mix),
    ("SentencePiece", sentencepiece_ids),
]

#: The learned rules, the multipliers of the mix and the tokenizer are not SQL; tests/llm/test_pipeline.py follows the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = stored(out, name.replace(" ", "_")) if i < len(STAGES) - 1 else out
    return docs

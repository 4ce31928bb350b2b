"""Registered queries of the subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import article, divergence, lines, lm, minhash, mixing, pieces, pseudonyms, quality, syncmers, tokens, toxicity, whitening
from .shared import documents


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(documents(spark, sf_dir))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(documents(spark, sf_dir))


ORACLES["op9_line_dedup"] = lines.ORACLE


@query
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), shingle=4)


@query
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return tokens.with_counts(docs, tokenizer("byte_bpe_50k.json"), limit=512).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = pieces.encoded(docs, tokenizer("piece_bpe_32k.model"))
    return rows.select("doc_id", F.greatest(F.size("sp_ids"), F.lit(0)).cast("long").alias("n_pieces"), F.coalesce("sp_bytes", F.lit(0)).cast("long").alias("n_bytes"), F.col("sp_ids").alias("ids"), F.col("sp_back").alias("decoded_sha256"), F.col("sp_same").alias("same"))


@query
def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare(documents(spark, sf_dir))


@query
def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a key for test tables, in the open; real ones come from the caller or the session
    rows = pseudonyms.pseudonymized(documents(spark, sf_dir).select("doc_id", "text"), key=b"test tables only")
    return rows.select("doc_id", F.size("ps_spans").cast("long").alias("n_found"), "text", F.col("ps_spans").alias("spans"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


@query
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


ORACLES["op12_divergence"] = divergence.ORACLE


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(documents(spark, sf_dir, "embeddings"))


@query
def op13_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article.extract(documents(spark, sf_dir, "pages"))

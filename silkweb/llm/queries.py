"""The operators' queries over the driver's tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from silkweb.llm import bpe, exact_dedup, hard_negatives, maxent, minhash, mixing, quality, sharding, unigram, urlfilter, vectors, whitening, word_bpe
from silkweb.llm.common import table
from silkweb.llm.urlfilter import Rule

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_PAIRS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
URL_RULES = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow")]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram tokens of every document."""
    return unigram.token_counts(table(spark, sf_dir, "documents"), PIECES)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicates of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.digest(table(spark, sf_dir, "documents"))


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays for every document."""
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text encoded and decoded again, as digests."""
    return bpe.round_trip_digest(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every document."""
    return maxent.scores(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every document."""
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.digest(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First negatives of each positive of every anchor."""
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text encoded to lower-cased words' tokens and decoded again, as digests."""
    return word_bpe.round_trip_digest(table(spark, sf_dir, "documents"), WORD_PAIRS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_minhash_dedup, op3_mix_sources, op4_vector_dedup, op5_url_filter, op6_exact_dedup, op7_byte_bpe, op8_lm_score, op9_quality, op10_shard, op11_hard_negatives, op12_whitening, op13_word_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_dedup": minhash.SQL, "op3_mix_sources": mixing.SQL, "op4_vector_dedup": vectors.SQL, "op6_exact_dedup": exact_dedup.SQL, "op11_hard_negatives": hard_negatives.SQL}

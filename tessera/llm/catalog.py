"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import (
    bpe, chat, embed_dedup, hmm, html_text, mixing, pii, prefix_trie, quality, secret_scan, simhash, token_align, toxicity)
from tessera.llm.oracle import SQL  # noqa: F401  (the twins, for the driver)
from tessera.session import table


def vocabulary() -> tuple[str, str]:
    """The rank file and the pre-token pattern of the production tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_hmm_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.fit_and_score(table(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op3_poisson_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(table(spark, sf_dir, "documents"))


def op4_transcript_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op5_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), *vocabulary())


def op7_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_figures(table(spark, sf_dir, "documents"))


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op10_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_toxicity_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    voc = token_align.vocabularies(public_tokenizers.path("byte_bpe_50k.json"),
                                   public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
    return token_align.align(table(spark, sf_dir, "documents"), voc)


QUERIES = {f.__name__: f for f in (
    op1_hmm_language_model, op2_personal_data, op3_poisson_mixture, op4_transcript_roles,
    op5_simhash_golay, op6_bpe_round_trip, op7_host_paths, op8_quality_perplexity, op9_secret_ledger, op10_spherical_caps,
    op11_prefix_trie, op12_toxicity_ngrams, op13_token_alignment)}

"""Queries of the llm operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import language_model, media, mixing, near_duplicates, packing, pii, secrets, tokens, toxicity, vectors
from .store import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op3_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_classes(table(spark, sf_dir, "embeddings"))


def embedding_planted_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate classes of the embeddings with two near copies of each added."""
    return vectors.near_classes(vectors.with_planted_copies(table(spark, sf_dir, "embeddings")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op5_lm_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.perplexity(table(spark, sf_dir, "documents"), order=3)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "pages"), "page_id", "html")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_tokens(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents with their scores."""
    scored = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.where("toxic")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_conversations(table(spark, sf_dir, "conversations"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_ngram_jaccard": op2_ngram_jaccard,
        "op3_embedding_near_duplicates": op3_embedding_near_duplicates,
        "op4_secret_scan": op4_secret_scan,
        "op5_lm_perplexity": op5_lm_perplexity,
        "op6_media_columns": op6_media_columns,
        "op7_token_counts": op7_token_counts,
        "op8_toxicity": op8_toxicity,
        "op9_packing": op9_packing,
        "op10_pii": op10_pii,
        "embedding_planted_copies": embedding_planted_copies,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": mixing.SQL,
        "op2_ngram_jaccard": near_duplicates.SQL,
        "op3_embedding_near_duplicates": vectors.SQL,
        "embedding_planted_copies": vectors.SQL_PLANTED,
    }

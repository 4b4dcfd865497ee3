"""One registered query for each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import best_fit_packing, byte_bpe, exact_dedup, hamming_search, html_text, language_id, minhash_dedup, substring_dedup, token_counts, toxicity

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(_documents(spark, sf_dir))


def op2_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_search.embedding_search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_dedup(_documents(spark, sf_dir))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(_documents(spark, sf_dir), BYTE_BPE)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.best_fit_packing(_documents(spark, sf_dir), WORD_BPE)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), BYTE_BPE, token_counts.derived_edits())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity(_documents(spark, sf_dir), labels).drop("passages")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_substring_dedup,
        op2_hamming_search,
        op3_minhash_dedup,
        op4_byte_bpe,
        op5_html_text,
        op6_best_fit_packing,
        op7_exact_dedup,
        op8_token_counts,
        op9_toxicity,
        op10_language_id,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_hamming_search": hamming_search.SQL, "op7_exact_dedup": exact_dedup.SQL}

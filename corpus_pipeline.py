"""Corpus pipeline: five stages from raw documents to packed training sequences.

Each stage works on all that the one before it kept. All but the last return the columns of documents.
Language ID and near-dedup learn from, and compare, every document they are given.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import best_fit_packing, exact_dedup, language_id, minhash_dedup, substring_dedup
from tidemark.llm.shared import Scratch, small

#: A document whose language is less certain than this is rejected, as is one without any letter.
LEAST_CERTAIN = 0.5


def _unique(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs), where each row counts by itself: if any doc_id is null or repeated, rows have keys instead
    while work runs, in the order of their doc_ids, null ids last."""
    odd = docs.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if odd.isEmpty():
        return work(docs)
    rows = docs.orderBy(F.col("doc_id").asc_nulls_last(), "text").withColumn("__own_id", F.col("doc_id"))
    keyed = Scratch(docs.sparkSession, "keyed").save(rows.withColumn("doc_id", F.monotonically_increasing_id()))
    return work(keyed).withColumn("doc_id", F.col("__own_id")).select(*docs.columns)


def _kept(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of docs, whose doc_ids are unique, that a verdict table(doc_id, kept) keeps."""
    keep = Scratch(docs.sparkSession, "kept").save(verdicts.where("kept").select("doc_id"))
    return docs.join(small(keep), "doc_id", "left_semi").select(*docs.columns)


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters, or with no likely language, go."""
    found = language_id.identify(docs, *language_id.fit(docs), keep=tuple(c for c in docs.columns if c != "text"), carry_text=True, names=("__lang", "__certain"))
    return found.where((F.col("__lang") != "und") & (F.col("__certain") >= LEAST_CERTAIN)).select(*docs.columns)


def stage_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _unique(docs, lambda rows: _kept(rows, exact_dedup.exact_dedup(rows)))


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    return _unique(docs, lambda rows: _kept(rows, minhash_dedup.near_dedup(rows)))


def stage_substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id also holds are cut out."""

    def cut(rows: DataFrame) -> DataFrame:
        return substring_dedup.without_passages(rows, Scratch(spark, "passages").save(substring_dedup.passages(rows)))

    return _unique(docs, cut)


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", stage_language),
    ("exact_dedup", stage_exact),
    ("near_dedup", stage_near),
    ("substring_dedup", stage_substring),
    ("best_fit_packing", stage_pack),
]

#: SQL cannot express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

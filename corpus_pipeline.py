"""The corpus pipeline: documents in, token files out, a stored table between the stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from parley.llm import decontaminate, mixing, quality, simhash, tokens
from parley.llm.queries import DOMAINS, WEIGHTS
from parley.llm.worker import small_batches
from parley.sources.store import materialise


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects go."""
    small_batches(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), least=0.3)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    small_batches(spark)
    return simhash.keep_one_of_each(docs, shingle=5, similarity=0.8)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), q=12, rate=0.06)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The production mix; a document that two epochs take comes twice."""
    return mixing.mix(docs, DOMAINS, WEIGHTS, share=1.0, epochs=2, seed=7).select(*docs.columns)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what they say of each document."""
    small_batches(spark)
    return tokens.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("quality classifier", good_quality), ("SimHash near-dedup", one_of_each), ("benchmark decontamination", clean),
    ("mixing sources to target weights", mixed), ("token-ID / binary output", tokenized)]

#: Trees, fingerprints and tokenizers are no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written to the shared folder and read back as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)

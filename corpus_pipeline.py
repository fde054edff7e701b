"""The corpus pipeline: toxic documents go, then copies, near copies and leaked benchmark passages; the rest is encoded."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybrook.llm import bloom, exact, superminhash, tiling, toxicity, unigram
from daybrook.session import materialize, prepare


def clean_speech(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go.  It is trained on the labelled rows among ``docs``."""
    score = toxicity.scorer(toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return docs.where(score(F.col("text")) < 0.5)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays, the one with the largest id."""
    return exact.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id."""
    groups = superminhash.near_groups(docs, 80)
    return bloom.without(docs, materialize(groups.where("not kept").select("doc_id"), "dropped"))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    leaked = tiling.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return bloom.without(docs, materialize(leaked.select("doc_id").distinct(), "leaked"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, n_ids, text)``: piece ids of every document, and the text that they decode to."""
    coded = unigram.code(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.col("decoded").alias("text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("clean_speech", clean_speech),
    ("copies", copies),
    ("near_copies", near_copies),
    ("no_benchmark", no_benchmark),
    ("pieces", pieces),
]

#: No SQL expresses a trained classifier, so the stages are tested against brute force one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

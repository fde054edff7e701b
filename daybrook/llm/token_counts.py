"""Token counts through a cache keyed by content digest and tokenizer version."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybrook.llm import bloom, tokenizing, words
from daybrook.session import materialize

ENTRY = "sha binary, n_tokens long"


def counter(path: str):
    """A column function: tokens of a text, as the library counts them."""
    @F.arrow_udf("long")
    def count(text: pa.Array) -> pa.Array:
        encode, counts = tokenizing.encoder(path), []
        _, offsets = words.buffers(text)
        for first, last in words.slices(offsets):
            counts += [len(ids) // 4 for ids in encode(text.slice(first, last - first).to_pylist())]
        return pa.array(np.array(counts, np.int64))
    return count


def _normalised(text: Column) -> Column:
    """What is digested and encoded: counts must be exact, so only null changes, to empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row a digest."""
    try:
        rows = spark.read.schema(ENTRY).parquet(f"{cache}/version={version}/*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], ENTRY)
    return rows.groupBy("sha").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` per row; counts not yet in ``cache`` are encoded once per text and appended.

    A text whose digest two filters (digests in the cache, digests seen twice) both rule out is
    encoded where it is read.  Of the others, digests missing from the cache fetch one text each.
    Null text counts as empty; ids may be null or repeated.
    """
    spark, version = docs.sparkSession, tokenizing.version(tokenizer)
    body = _normalised(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("text", 256)))
    digests = materialize(rows.select("doc_id", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    stored = read_cache(spark, cache, version)
    celled = digests.select("doc_id", "sha", bloom.cell(F.col("sha")).alias("cell"))
    seen = materialize(bloom.repeated_pages(celled), "seen")
    known = materialize(bloom.pages(stored.select(bloom.cell(F.col("sha")).alias("cell"))), "known")

    def split(table: DataFrame) -> DataFrame:
        return bloom.flagged(bloom.flagged(table, seen, "cell", "twice"), known, "cell", "cached")

    shared = split(celled).where("twice or cached").groupBy("sha").agg(F.min("doc_id").alias("first_id"))
    missing = materialize(shared.join(stored, "sha", "left_anti"), "missing")
    count = counter(tokenizer)
    texts = split(rows.withColumn("cell", bloom.cell(F.col("sha"))))
    direct = texts.where("not twice and not cached").select("sha", count("text").alias("n_tokens"))
    wanted = missing.select(F.col("sha").alias("of"), "first_id").hint("shuffle_hash")
    one = texts.where("twice or cached").join(wanted, (F.col("sha") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    fetched = one.select("sha", count("text").alias("n_tokens")).groupBy("sha").agg(F.max("n_tokens").alias("n_tokens"))
    direct.unionByName(fetched).write.parquet(f"{cache}/version={version}/batch={uuid.uuid4().hex}")
    return digests.join(read_cache(spark, cache, version), "sha").select("doc_id", "n_bytes", "n_tokens")

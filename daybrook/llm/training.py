"""Bounded training samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most; a sample of this size fits the driver and may be broadcast.
FIT_ROWS = 20_000


def remainder(doc_id: Column, modulus: int) -> Column:
    return F.crc32(doc_id.cast("string")) % F.lit(modulus)


def sample(ids: DataFrame, *keep: str, rows: int = FIT_ROWS) -> DataFrame:
    """At most ``rows`` rows, chosen by a hash of the id; the same ones on every run."""
    return ids.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(rows).select("doc_id", *keep)


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The texts of a bounded sample, one row an id: an id that comes again gives its smallest text.

    At most ``FIT_ROWS`` ids are broadcast.
    """
    keep = [c for c in chosen.columns if c != "doc_id"]
    met = docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id", *keep).agg(F.min("text").alias("text"))

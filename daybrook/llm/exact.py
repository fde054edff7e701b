"""Exact duplicates by two passes over a bit filter, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybrook.llm import bloom
from daybrook.session import materialize


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def _repeated(digests: DataFrame) -> DataFrame:
    """Pass one: the filter pages of digests that may occur twice."""
    cells = digests.select(bloom.cell(F.col("sha")).alias("cell"))
    return materialize(bloom.repeated_pages(cells), "pages")


def copies(docs: DataFrame) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` per row: of equal texts, the largest id stays.

    Pass one marks the filter cells that two digests fall into.  In pass two only rows with a
    marked cell are shuffled and grouped by digest; all others are alone and pass through.
    Null text counts as empty.  An id that is null is smaller than any other; rows that repeat
    the id and the text of the row that stays are reported as kept like it.
    """
    digests = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _sha(F.col("text")).alias("sha")), "digests")
    rows = bloom.flagged(digests.withColumn("cell", bloom.cell(F.col("sha"))), _repeated(digests))
    suspects = rows.where("maybe").select("doc_id", "sha")
    groups = materialize(suspects.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    alone = rows.where("not maybe").select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    found = alone.unionByName(suspects.join(groups, "sha").select("doc_id", "sha", "keep_id", "group_size"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each text, the one with the largest id; whole rows of a text seen once are never shuffled.

    Rows that repeat both id and text count as copies too: one of them stays.  Columns may have
    any name but ``_daybrook_*``.
    """
    digests = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _sha(F.col("text")).alias("sha")), "digests")
    pages = _repeated(digests)
    suspects = bloom.flagged(digests.withColumn("cell", bloom.cell(F.col("sha"))), pages).where("maybe")
    stays = materialize(suspects.groupBy("sha").agg(F.max("doc_id").alias("keep_id")), "stays").select(
        F.col("sha").alias("_daybrook_of"), F.col("keep_id").alias("_daybrook_keep"))
    marked = docs.withColumn("_daybrook_sha", _sha(F.col("text"))).withColumn("_daybrook_cell", bloom.cell(F.col("_daybrook_sha")))
    marked = bloom.flagged(marked, pages, "_daybrook_cell", "_daybrook_maybe")
    chosen = marked.where("_daybrook_maybe").join(
        stays, (F.col("_daybrook_sha") == F.col("_daybrook_of")) & F.col("doc_id").eqNullSafe(F.col("_daybrook_keep")), "left_semi")
    chosen = chosen.dropDuplicates(["_daybrook_sha", "doc_id"])
    return marked.where("not _daybrook_maybe").unionByName(chosen).select(*(F.col(f"`{c}`") for c in docs.columns))

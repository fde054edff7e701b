"""Near-duplicate groups: SuperMinHash signatures, banding, checks on whole sets, union-find."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybrook.llm import bloom, words
from daybrook.llm.groups import components
from daybrook.session import materialize

#: Bands and rows of a band at least and at most, and the ranks that they should not exceed.
BANDS, ROWS, MOST_RANKS = 32, 6, 256
RANKS = BANDS * ROWS
#: Probability at most with which a pair at the similarity itself meets in no band.
MISSED = math.exp(-15)
_LEVEL = np.uint64(56)


def shape(percent: int) -> tuple[int, int]:
    """Bands and rows of a band for a similarity: the longest rows whose bands miss a pair with ``MISSED`` at most."""
    share = min(percent / 100, 0.99)
    for rows in range(ROWS, 0, -1):
        count = max(BANDS, math.ceil(math.log(MISSED) / math.log1p(-share ** rows)))
        if count * rows <= MOST_RANKS or rows == 1:
            return count, rows
    raise ValueError("no rows in a band")


def signatures(values: np.ndarray, counts: np.ndarray, ranks: int = RANKS) -> np.ndarray:
    """SuperMinHash signature of each row's distinct values, ``ranks`` 64-bit numbers a row.

    Every value walks through its own permutation of the ranks, and step ``j`` may only give
    a number between ``j`` and ``j + 1`` (the level is the top byte).  A row stops at the first
    step after which all its ranks have a number: later steps can only give larger ones.
    """
    rows = np.repeat(np.arange(len(counts)), counts)
    full = np.full(len(counts) * ranks, np.uint64(2**64 - 1))
    order, step = None, 0
    with np.errstate(over="ignore"):
        while len(values) and step < ranks:
            draw = words.mix(values + np.uint64(step + 1) * np.uint64(0xD1B54A32D192ED03))
            place = step + ((draw >> np.uint64(32)) * np.uint64(ranks - step) >> np.uint64(32)).astype(np.int64)
            if order is None:
                slot = place
            else:
                each = np.arange(len(values))
                slot = order[each, place].copy()
                order[each, place] = order[:, step]
                order[:, step] = slot
            number = (words.mix(draw ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(8)) | (np.uint64(step) << _LEVEL)
            np.minimum.at(full, rows * ranks + slot, number)
            open_rows = (full.reshape(-1, ranks) == np.uint64(2**64 - 1)).any(axis=1)
            stay = open_rows[rows]
            if order is None:
                order = np.tile(np.arange(ranks, dtype=np.uint8 if ranks <= 256 else np.uint16), (int(stay.sum()), 1))
                kept = place[stay]
                each = np.arange(len(kept))
                order[each, kept] = 0
                order[:, 0] = kept
            else:
                order = order[stay]
            values, rows, step = values[stay], rows[stay], step + 1
    return full.reshape(-1, ranks)


def bands(signature: np.ndarray, count: int = BANDS) -> np.ndarray:
    """One hash a band; the band's number is part of it."""
    parts = signature.reshape(len(signature), count, -1)
    with np.errstate(over="ignore"):
        sums = (words.mix(parts) * words.WEIGHT[:parts.shape[2]]).sum(axis=2, dtype=np.uint64)
        return words.mix(sums + np.arange(count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sketch(count: int, length: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.buffers(batch.column("text"))
            for first, last in words.slices(offsets):
                found, counts = words.shingles(*words.hash_words(data, offsets[first:last + 1]))
                found, counts = words.distinct(found, counts)
                keys = bands(signatures(found, counts, count * length), count).view(np.int64).ravel()
                with np.errstate(over="ignore"):
                    digests = [words.row_sums(words.mix(found ^ words.WEIGHT[k]), counts).view(np.int64) for k in (8, 9)]
                where = np.arange(0, len(keys) + 1, count, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array(counts), pa.array(digests[0]), pa.array(digests[1]),
                     pa.ListArray.from_arrays(where, pa.array(keys))],
                    names=["doc_id", "n", "d1", "d2", "bands"])
    return sketch


def _sets(count: int, length: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.buffers(batch.column("text"))
            for first, last in words.slices(offsets):
                found, counts = words.distinct(*words.shingles(*words.hash_words(data, offsets[first:last + 1])))
                where = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                keys = bands(signatures(found, counts, count * length), count).view(np.int64).ravel()
                at = np.arange(len(counts) + 1, dtype=np.int32) * count
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.ListArray.from_arrays(where, pa.array(found.view(np.int64))),
                     pa.ListArray.from_arrays(at, pa.array(keys))], names=["id", "own", "keys"])
    return sets


def _alike(one: str | Column, other: str | Column, percent: int) -> Column:
    """Sizes that allow the similarity at all."""
    return F.lit(100) * F.least(one, other) >= F.lit(percent) * F.greatest(one, other)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets reach the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("own").alias("a_own"))
    right = sets.select(F.col("id").alias("b"), F.col("own").alias("b_own"))
    shared = F.size(F.array_intersect("a_own", "b_own"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", shared.alias("shared"), (F.size("a_own") + F.size("b_own")).alias("total"))
    return both.where(F.lit(100) * F.col("shared") >= F.lit(percent) * (F.col("total") - F.col("shared"))).select("a", "b")


def _apart(spots: DataFrame, percent: int) -> DataFrame:
    """Linked pairs among classes that stand in one bucket under different roots, judged on whole sets within the join."""
    one = spots.select("h", *(F.col(c).alias(f"a_{c}") for c in ("rep", "n", "root", "keys", "own")))
    apart = (F.col("a_rep") < F.col("rep")) & (F.col("a_root") != F.col("root")) & _alike("a_n", "n", percent)
    once = F.array_min(F.array_intersect("a_keys", "keys")) == F.col("h")
    # 100 s >= percent (total - s), with the shared part named once
    shared = F.size(F.array_intersect("a_own", "own")) * F.lit(100 + percent)
    linked = shared >= F.lit(percent) * (F.size("a_own") + F.size("own"))
    return spots.join(one, "h").where(apart & once & linked).select(F.col("a_rep").alias("a"), F.col("rep").alias("b"))


def near_groups(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row: groups linked by shingle sets alike in ``percent`` of 100.

    Equal sets become one class before anything is compared.  In a bucket of a band, every class
    meets the bucket's best-connected one; classes that this leaves in different components of
    the same bucket all meet each other.  Every link is judged on whole sets, so only a pair that
    meets in no band is missed.  A row without
    words or without an id is linked with nothing; its component is its own id.  Rows with the
    same id count as one document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    count, length = shape(percent)
    sketch = materialize(rows.mapInArrow(_sketch(count, length), "doc_id long, n long, d1 long, d2 long, bands array<long>"), "sketch")
    usable = sketch.where("n > 0 and doc_id is not null")
    classes = materialize(usable.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")), "classes")
    dealt = classes.select("rep", "n", F.explode("bands").alias("h"))
    shared = dealt.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    members = materialize(dealt.join(shared, "h"), "members")

    chosen = members.select("rep").distinct()
    filter_pages = bloom.pages(chosen.select(bloom.cell(F.col("rep")).alias("cell")))
    maybe = bloom.flagged(rows.where("doc_id is not null").withColumn("cell", bloom.cell(F.col("doc_id"))), filter_pages).where("maybe")
    wanted = maybe.join(chosen.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    sets = materialize(wanted.mapInArrow(_sets(count, length), "id long, own array<long>, keys array<long>"), "sets")

    weight = members.groupBy("rep").agg(F.sum("c").alias("weight"))
    best = members.join(weight, "rep").groupBy("h").agg(F.max(F.struct("weight", (-F.col("rep")).alias("back"), "n")).alias("top"))
    hub = best.select("h", (-F.col("top.back")).alias("a"), F.col("top.n").alias("a_n"))
    pairs = members.join(hub, "h").where((F.col("a") != F.col("rep")) & _alike("a_n", "n", percent))
    tested = materialize(pairs.select("a", F.col("rep").alias("b")).distinct(), "pairs")
    links = materialize(_verified(tested, sets, percent), "links")
    roots = materialize(components(links), "roots")

    spots = members.join(roots.withColumnRenamed("v", "rep"), "rep", "left").select("h", "rep", "n", F.coalesce("root", "rep").alias("root"))
    mixed = spots.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h")
    spots = spots.join(mixed, "h").join(sets.select(F.col("id").alias("rep"), "keys", "own"), "rep")
    spots = materialize(spots, "spots")
    rest = materialize(_apart(spots, percent), "rest")
    if not rest.isEmpty():
        links = links.unionByName(rest)
        roots = materialize(components(links), "roots")

    of_class = classes.select("n", "d1", "d2", "rep").join(roots.withColumnRenamed("v", "rep"), "rep", "left").select(
        "n", "d1", "d2", F.coalesce("root", "rep").alias("root"))
    of_class = materialize(of_class, "of_class")
    linked = usable.select("doc_id", "n", "d1", "d2").join(of_class, ["n", "d1", "d2"]).select("doc_id", "n", "root")
    alone = sketch.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("root"))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"),
                                            F.col("doc_id").eqNullSafe(F.col("root")).alias("kept"))

"""Benchmark decontamination: shared shingles as seeds, greedy string tiling by running Karp-Rabin, coverage of the test item."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from daybrook.llm import bloom, words
from daybrook.session import materialize

#: Words that a tile has at least, and the share of an item's words that tiles must cover.
TILE, COVERAGE = words.WIDTH, 0.7


def _windows(tokens: np.ndarray, free: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and Karp-Rabin hash of every window of ``length`` unmarked tokens that stand side by side."""
    n = len(tokens) - length + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        hashed = np.zeros(n, np.uint64)
        for k in range(length):  # Horner's rule over all windows at once
            hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + tokens[k:k + n]
    taken = np.concatenate([[0], np.cumsum(~free)])
    whole = (taken[length:] - taken[:n] == 0) & (at[length - 1:] - at[:n] == length - 1)
    start = np.flatnonzero(whole)
    return start, hashed[start]


def covered(item: np.ndarray, text: np.ndarray, at: np.ndarray, tile: int = TILE) -> int:
    """Words of ``item`` that tiles cover in ``text``; ``at`` gives the place of each text word, gaps break a match.

    Searches windows of one length at a time.  Matches that a hash suggests are compared word by
    word and stretched to both sides; the longest are marked first and a marked word is never
    matched again.  A match more than twice as long as the window restarts the search with its
    length; otherwise the length is halved down to ``tile``.
    """
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    place = np.arange(len(item))
    length = max(tile, min(20, len(item), len(text)))
    while True:
        begin, hashed = _windows(text, free_text, at, length)
        seen: dict[int, list[int]] = {}
        for start, key in zip(begin.tolist(), hashed.tolist(), strict=True):
            seen.setdefault(key, []).append(start)
        longest, matches = 0, set()
        for i, key in zip(*(x.tolist() for x in _windows(item, free_item, place, length)), strict=True):
            for j in seen.get(key, ()):
                if i and j and free_item[i - 1] and free_text[j - 1] and at[j - 1] == at[j] - 1 and item[i - 1] == text[j - 1]:
                    continue  # the window before it matches too and stretches as far
                if not np.array_equal(item[i:i + length], text[j:j + length]):
                    continue
                a, b, size = i, j, length
                while a and b and free_item[a - 1] and free_text[b - 1] and at[b - 1] == at[b] - 1 and item[a - 1] == text[b - 1]:
                    a, b, size = a - 1, b - 1, size + 1
                while (a + size < len(item) and b + size < len(text) and free_item[a + size] and free_text[b + size]
                       and at[b + size] == at[b + size - 1] + 1 and item[a + size] == text[b + size]):
                    size += 1
                matches.add((-size, a, b))
                longest = max(longest, size)
        if longest > 2 * length:
            length = longest
            continue
        queue = sorted(matches)
        heapq.heapify(queue)
        while queue:
            size, a, b = heapq.heappop(queue)
            open_words = free_item[a:a - size] & free_text[b:b - size]
            if open_words.all():
                free_item[a:a - size] = free_text[b:b - size] = False
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], open_words.astype(np.int8), [0]])))
            for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if stop - start >= length:  # what others have left of the match waits for its turn
                    heapq.heappush(queue, (start - stop, a + start, b + start))
        if length == tile:
            return int((~free_item).sum())
        length = max(tile, length // 2)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = words.buffers(batch.column("text"))
        found, counts = words.hash_words(data, offsets)
        seeds, many = _seeds(found, counts)
        at = [np.concatenate([[0], np.cumsum(x)]).astype(np.int32) for x in (counts, many)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_id"), pa.ListArray.from_arrays(at[0], pa.array(found.view(np.int64))),
             pa.ListArray.from_arrays(at[1], pa.array(seeds.view(np.int64)))], names=["item_id", "words", "seeds"])


def _seeds(found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of rows that have enough words for one; shorter rows have none."""
    seeds, many = words.shingles(found, counts)
    usable = counts >= TILE
    return seeds[np.repeat(usable, many)], np.where(usable, many, 0)


def _hits(shared):
    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            data, offsets = words.buffers(batch.column("text"))
            for first, last in words.slices(offsets):
                found, counts = words.hash_words(data, offsets[first:last + 1])
                seeds, many = _seeds(found, counts)
                cell = (seeds & np.uint64(bloom.BITS - 1)).astype(np.int64)
                hit = (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1
                ends, starts = np.cumsum(many), np.cumsum(counts) - counts
                rows = np.flatnonzero(np.add.reduceat(np.append(hit, 0), np.minimum(ends - many, len(hit))) * (many > 0)) if len(hit) else []
                out = {"doc_id": [], "at": [], "words": [], "seeds": []}
                for row in rows:
                    own = np.flatnonzero(hit[ends[row] - many[row]:ends[row]])
                    spots = np.unique((own[:, None] + np.arange(TILE)).ravel())
                    out["doc_id"].append(batch.column("doc_id")[first + int(row)].as_py())
                    out["at"].append(spots.astype(np.int32))
                    out["words"].append(found[starts[row] + spots].view(np.int64))
                    out["seeds"].append(np.unique(seeds[ends[row] - many[row] + own]).view(np.int64))
                if out["doc_id"]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out["doc_id"], pa.int64()), *(pa.array(out[k], pa.list_(kind)) for k, kind in
                                                              (("at", pa.int32()), ("words", pa.int64()), ("seeds", pa.int64())))],
                        names=["doc_id", "at", "words", "seeds"])
    return hits


@F.arrow_udf(IntegerType())
def _tiled(item: pa.Array, text: pa.Array, at: pa.Array) -> pa.Array:
    """Covered words of each pair."""
    def row(column: pa.Array, k: int) -> np.ndarray:
        return column[k].values.to_numpy(zero_copy_only=False)
    return pa.array([covered(row(item, k).view(np.uint64), row(text, k).view(np.uint64), row(at, k)) for k in range(len(item))], pa.int32())


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``(doc_id, item_id, covered, item_words)``: documents whose words tile ``coverage`` of a benchmark item or more.

    A bit filter over the benchmark's shingles, of a fixed size, picks the places of documents that
    may match; only their word hashes leave the scan.  They meet the items by shared shingles, each
    weighed by how often the item has it; a pair that shares too few to reach the coverage is not
    tiled.  Order does not matter, so passages that are shuffled about are found.  Items with the same words count as the one with the smallest id.
    Items shorter than a tile match nothing, and rows without an id, text or words leak nothing.
    """
    spark = docs.sparkSession
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = rows.mapInArrow(_items, "item_id long, words array<long>, seeds array<long>").where(F.size("words") >= TILE)
    items = materialize(items.groupBy("words").agg(F.min("item_id").alias("item_id"), F.any_value("seeds").alias("seeds")), "items")
    seeds = items.select("item_id", F.size("words").alias("item_words"), F.explode("seeds").alias("seed"))
    seeds = materialize(seeds.groupBy("item_id", "item_words", "seed").agg(F.count("*").alias("times")), "seeds")
    cells = seeds.select((F.col("seed").bitwiseAND(F.lit(bloom.BITS - 1)) + 1).alias("cell"))
    bits = bytearray(bloom.BITS // 8)
    for row in bloom.pages(cells).toLocalIterator():  # at most BITS / 8 bytes, whatever the benchmark's size
        start = (row["page"] - 1) * 4096
        bits[start:start + 4096] = row["bits"]
    shared = spark.sparkContext.broadcast(bytes(bits))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hits = materialize(texts.mapInArrow(_hits(shared), "doc_id long, at array<int>, words array<long>, seeds array<long>"), "hits")
    met = hits.select("doc_id", F.explode("seeds").alias("seed")).join(seeds, "seed")
    pairs = met.groupBy("doc_id", "item_id", "item_words").agg(F.sum("times").alias("shared"))
    pairs = materialize(pairs.where(F.col("shared") * TILE >= F.lit(coverage) * F.col("item_words")), "tile_pairs")
    ready = pairs.join(hits.select("doc_id", "at", "words"), "doc_id").join(items.select("item_id", F.col("words").alias("item")), "item_id")
    tiled = ready.select("doc_id", "item_id", "item_words", _tiled("item", "words", "at").alias("covered"))
    best = tiled.groupBy("doc_id", "item_id", "item_words").agg(F.max("covered").alias("covered"))
    return best.where(F.col("covered") >= F.lit(coverage) * F.col("item_words")).select("doc_id", "item_id", "covered", "item_words")

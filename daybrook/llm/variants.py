"""Spelling variants: words at one error from a much more frequent word, by searches in suffix-rank indexes.

A word and a near word share the first or the second half of the word.  The sorted vocabulary is cut
into ranges, each a delimited text with an index of its own; a word visits the ranges that may hold its
first half.  The second pass does the same with all words read backwards.  What comes back is one row a
word and range (how many near words, the best of them), never a pair.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybrook.llm import fm_index
from daybrook.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"
#: One run in so many loses a letter; shortest word, fewest occurrences, ratio of a form to its word.
SLIP, MIN_LENGTH, MIN_COUNT, RATIO = 199, 6, 5, 5
#: Words of one index, and queries that one task asks it.
SHARD = 1 << 16


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)`` of the words of all texts; a document without an id has an empty one in the digest of a slip."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(own.alias("own"), F.explode(F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_length)
    h = F.crc32(F.concat_ws(":", "own", "run"))
    at = (h % F.length("run")).cast("int")
    slipped = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(h % SLIP == 0, slipped).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _router(firsts: list[str], lasts: list[str], parts: list[int], backward: bool):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, shards = [], []
            for place, key in enumerate(batch.column("key").to_pylist()):
                half = key[:(len(key) + backward) // 2]
                low, high = bisect.bisect_left(lasts, half), bisect.bisect_right(firsts, half + "\U0010ffff")
                rows += [place] * (high - low)
                shards += parts[low:high]
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), batch.column("key").take(pa.array(rows, pa.int64()))], names=["shard", "key"])
    return route


def _searcher(backward: bool):
    def search(rows: pa.Table) -> pa.Table:
        asked = rows.filter(pa.compute.is_null(rows.column("n"))).column("key").to_pylist()
        held = rows.filter(pa.compute.is_valid(rows.column("n"))).sort_by("key")
        texts, counts = held.column("key").to_pylist(), held.column("n").to_numpy()
        empty = pa.table({"key": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "top_n": pa.array([], pa.int64()), "top": pa.array([], pa.string())})
        if not texts or not asked:
            return empty
        halves = [(len(q) + backward) // 2 for q in asked]
        found = list(fm_index.Index(texts).near(asked, halves))
        if not found:
            return empty
        query, word = (np.concatenate(x) for x in zip(*found, strict=True))
        if backward:
            # what also shares the first half was found reading forward
            rest = [len(q) - half for q, half in zip(asked, halves, strict=True)]
            keep = np.fromiter((asked[q][-rest[q]:] != texts[w][-rest[q]:] for q, w in zip(query, word, strict=True)), bool, len(query))
            query, word = query[keep], word[keep]
        names = [text[::-1] for text in texts] if backward else texts
        rank = np.empty(len(names), np.int64)
        rank[np.array(sorted(range(len(names)), key=names.__getitem__))] = np.arange(len(names))
        order = np.lexsort((rank[word], -counts[word], query))
        query, word = query[order], word[order]
        heads = np.flatnonzero(np.diff(query, prepend=-1))
        return pa.table({
            "key": pa.array([asked[q] for q in query[heads]], pa.string()), "n_near": pa.array(np.diff(np.append(heads, len(query)))),
            "top_n": pa.array(counts[word[heads]]), "top": pa.array([names[w] for w in word[heads]], pa.string())})
    return search


def _half(words: DataFrame, size: int, backward: bool, shard: int) -> DataFrame:
    """``(word, n_near, top_n, top)`` per word and range, for near words that share the first half of a word, or of it read backwards."""
    spark = words.sparkSession
    key: Column = F.reverse("word") if backward else F.col("word")
    ranged = words.select(key.alias("key"), "n").repartitionByRange(max(1, -(-size // shard)), "key")
    ranged = materialize(ranged.withColumn("shard", F.spark_partition_id()), "shards")
    # one row a range
    bounds = ranged.groupBy("shard").agg(F.min("key").alias("first"), F.max("key").alias("last")).orderBy("first").collect()
    route = _router([r["first"] for r in bounds], [r["last"] for r in bounds], [r["shard"] for r in bounds], backward)
    asked = materialize(ranged.select("key").mapInArrow(route, "shard int, key string"), "routed")
    loads = asked.groupBy("shard").agg(F.count("*").alias("asked")).select("shard", F.ceil(F.col("asked") / (2 * shard)).cast("int").alias("salts"))
    loads = F.broadcast(spark.createDataFrame(loads.collect(), "shard int, salts int"))
    texts = ranged.join(loads, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "key", "n")
    asked = asked.join(loads, "shard").select("shard", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt"), "key", F.lit(None).cast("long").alias("n"))
    found = texts.unionByName(asked).groupBy("shard", "salt").applyInArrow(_searcher(backward), "key string, n_near long, top_n long, top string")
    return found.select((F.reverse("key") if backward else F.col("key")).alias("word"), "n_near", "top_n", "top")


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """``(word, n_near, top_n, top)`` for the words of ``(word, n)`` that have near words: how many, and the one with most occurrences."""
    size = words.count()
    both = _half(words, size, False, shard).unionByName(_half(words, size, True, shard))
    best = F.min(F.struct((-F.col("top_n")).alias("n"), F.col("top").alias("word"))).alias("best")
    return both.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.n")).alias("top_n"), F.col("best.word").alias("top"))


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for every word of ``(word, form)``; each pass doubles how far a word looks."""
    ahead = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while not ahead.join(ahead.select(F.col("word").alias("root")), "root", "left_semi").isEmpty():
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = materialize(ahead.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return ahead


def variants(docs: DataFrame, ratio: int = RATIO, shard: int = SHARD) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` per word of the vocabulary.

    ``form`` is the near word with most occurrences (ties: the smallest) where it has ``ratio`` times the
    occurrences of the word; ``root`` follows forms to the last one.  Null and empty texts have no words;
    without words the result is empty.  Repeated rows count again.
    """
    words = materialize(vocabulary(docs), "vocabulary")
    joined = words.join(near_words(words, shard), "word", "left")
    good = F.col("top_n") >= ratio * F.col("n")
    formed = materialize(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                       F.when(good, F.col("top")).alias("form"), F.when(good, F.col("top_n")).alias("form_n")), "formed")
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

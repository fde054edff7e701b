"""Stupid-backoff scores: n-gram count tables partitioned by hash, met by the n-grams of buckets of documents."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybrook.llm import words

#: Longest n-gram, and what each step back costs.
ORDER, ALPHA = 3, 0.4
#: Bytes of text of a bucket (a block of documents) on average, and distinct n-grams of all buckets that a count table should hold.
BLOCK_BYTES, TABLE_ENTRIES = 4 << 20, 2_000_000
#: An n-gram's hash; its top bits name the table, the rest (48 bits at most) is its key there.
HASH_BITS, LEAST_BITS = 56, 8


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers by byte planes, deflated: small numbers are common, so most high bytes are zero."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes and words of each batch of texts."""
    for batch in batches:
        data, offsets = words.buffers(batch.column("text"))
        n_words = sum(len(words.word_starts(data, offsets[a:b + 1])[1]) for a, b in words.slices(offsets))
        yield pa.RecordBatch.from_arrays([pa.array([int(offsets[-1] - offsets[0])], pa.int64()), pa.array([n_words], pa.int64())], names=["n_bytes", "n_words"])


def _codec() -> pa.Codec:
    return pa.Codec("zstd", 1)


def _dealt(buckets: int) -> Callable:
    """Each row with its bucket and its text compressed; a row that comes again in a batch goes to another bucket."""
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec()
        for batch in batches:
            spot = batch.column("spot").to_numpy().view(np.uint64)
            _, place, times = np.unique(spot, return_inverse=True, return_counts=True)
            again = np.empty(len(spot), np.uint64)
            again[np.argsort(place, kind="stable")] = np.arange(len(spot)) - np.repeat(np.cumsum(times) - times, times)
            bucket = words.mix(spot ^ words.mix(again)) % np.uint64(buckets)
            data, offsets = words.buffers(batch.column("text"))
            texts = [codec.compress(data[a:b], asbytes=True) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.astype(np.int64)), batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(texts, pa.binary())],
                names=["bucket", "doc_id", "n_bytes", "text"])
    return dealt


def _words(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of a bucket's documents, and the number of words of each document."""
    codec = _codec()
    n_bytes = group.column("n_bytes").to_numpy()
    offsets = np.concatenate([[0], np.cumsum(n_bytes)])
    texts = zip(group.column("text").to_pylist(), n_bytes.tolist(), strict=True)
    data = np.frombuffer(b"".join(codec.decompress(raw, size, asbytes=True) for raw, size in texts if size), np.uint8)
    parts = [words.hash_words(data, offsets[a:b + 1]) for a, b in words.slices(offsets)]
    return np.concatenate([found for found, _ in parts]), np.concatenate([sizes for _, sizes in parts])


def _steps(keys: np.ndarray) -> bytes:
    """Ascending 48-bit keys as differences: four bytes each, and the others, mostly small and zero, deflated at the end."""
    wide = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    deflate = zlib.compressobj(strategy=zlib.Z_RLE)
    return np.ascontiguousarray(wide[:, :4]).tobytes() + deflate.compress(np.ascontiguousarray(wide[:, 4:6].T).tobytes()) + deflate.flush()


def _unstepped(raw: bytes, count: int) -> np.ndarray:
    wide = np.zeros((count, 8), np.uint8)
    wide[:, :4] = np.frombuffer(raw, np.uint8, 4 * count).reshape(-1, 4)
    wide[:, 4:6] = np.frombuffer(zlib.decompress(raw[4 * count:]), np.uint8).reshape(2, count).T
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def _grams(group: pa.Table, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hash of the n-gram that ends at each word, by length, 0 where a document has too few words before; the document of each word; words of each."""
    found, sizes = _words(group)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    since = np.arange(len(found)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = []
    with np.errstate(over="ignore"):
        for length in range(1, order + 1):
            total = np.zeros(len(found), np.uint64)
            for back in range(length):
                total[back:] += found[:len(found) - back] * words.WEIGHT[16 + back]
            hashed = words.mix(total + np.uint64(length) * words.WEIGHT[31]) >> np.uint64(64 - HASH_BITS)
            out.append(np.where(since >= length - 1, np.maximum(hashed, np.uint64(1)), np.uint64(0)))
    return out, doc, sizes


def _distinct(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, times = np.unique(np.concatenate(grams), return_counts=True)
    return (keys[1:], times[1:]) if len(keys) and not keys[0] else (keys, times)


def _asked(order: int, bits: int) -> Callable:
    """What a bucket sends to every count table: the keys that fall there, ascending, and how often it has them."""
    def asked(key: tuple, group: pa.Table) -> pa.Table:
        keys, times = _distinct(_grams(group, order)[0])
        table = (keys >> np.uint64(HASH_BITS - bits)).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.diff(table, prepend=-1)), len(table))
        rest = keys & np.uint64((1 << (HASH_BITS - bits)) - 1)
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        return pa.table({"table": pa.array(table[cuts[:-1]], pa.int64()), "bucket": pa.array([key[0].as_py()] * len(spans), pa.int64()),
                         "keys": pa.array([_steps(rest[a:b]) for a, b in spans], pa.binary()),
                         "times": pa.array([_packed(times[a:b]) for a, b in spans], pa.binary())})
    return asked


def _answered(group: pa.Table) -> pa.Table:
    """One count table: add up what the buckets sent, and tell every bucket how often the others have its keys, in their order."""
    columns = group.to_pydict()
    each = [_unpacked(raw).astype(np.int64) for raw in columns["times"]]
    sizes = [len(own) for own in each]
    kinds, place = np.unique(np.concatenate([_unstepped(*x) for x in zip(columns["keys"], sizes, strict=True)]), return_inverse=True)
    times = np.concatenate(each)
    others = np.bincount(place, weights=times, minlength=len(kinds)).astype(np.int64)[place] - times
    cuts = np.cumsum([0, *sizes])
    # counts beyond 32 bits travel as a second half
    halves = [_packed(np.concatenate([others[a:b] & 0xFFFFFFFF, others[a:b] >> 32])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"table": pa.array(columns["table"], pa.int64()), "bucket": pa.array(columns["bucket"], pa.int64()), "others": pa.array(halves, pa.binary())})


def _scored(order: int, alpha: float, corpus: int) -> Callable:
    def scored(key: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        grams, doc, sizes = _grams(docs, order)
        keys, times = _distinct(grams)
        replies = replies.sort_by("table")
        others = []
        for raw in replies.column("others").to_pylist():
            both = _unpacked(raw).astype(np.int64)
            others.append(both[:len(both) // 2] + (both[len(both) // 2:] << 32))
        known = np.concatenate(others) if others else np.zeros(0, np.int64)
        if len(known) != len(keys):
            raise ValueError("a count table did not answer")
        known += times
        outside = []  # how often other documents have the n-gram that ends at each word
        for hashed in grams:
            at = np.searchsorted(keys, hashed)
            with np.errstate(over="ignore"):
                own = words.mix(hashed ^ words.mix(doc.astype(np.uint64) + np.uint64(1)))
            _, place, times = np.unique(own, return_inverse=True, return_counts=True)
            count = known[np.minimum(at, max(len(known) - 1, 0))] - times[place] if len(known) else np.zeros(len(hashed), np.int64)
            outside.append(np.where(hashed == 0, 0, count))
        score = np.full(len(doc), np.nan)
        tries = np.zeros(len(doc))
        for length in range(order, 1, -1):
            fits = np.isnan(score) & (grams[length - 1] != 0)
            before = np.roll(outside[length - 2], 1)
            hit = fits & (outside[length - 1] > 0)
            score[hit] = tries[hit] * np.log10(alpha) + np.log10(outside[length - 1][hit]) - np.log10(before[hit])
            tries[fits & ~hit] += 1
        rest = np.isnan(score)
        beyond = np.maximum(corpus - sizes[doc], 1)
        seen = rest & (outside[0] > 0)
        score[seen] = tries[seen] * np.log10(alpha) + np.log10(outside[0][seen]) - np.log10(beyond[seen])
        new = rest & ~seen
        score[new] = (tries[new] + 1) * np.log10(alpha) - np.log10(beyond[new])
        sums = np.bincount(doc, weights=score, minlength=len(sizes))
        backed = np.bincount(doc, weights=(tries > 0) | new, minlength=len(sizes)).astype(np.int64)
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(sizes), "n_backed_off": pa.array(backed),
                         "log10_score": pa.array(sums)})
    return scored


def backoff_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """``(doc_id, n_words, n_backed_off, log10_score)`` per row: stupid backoff against all other documents.

    The score of a word is the share of its n-gram among those of its context, or ``alpha`` times
    that of the next shorter n-gram; a word that no other document has counts as ``alpha`` times one.
    Counts leave out the document itself, so no text vouches for itself.  Documents are dealt by hash
    to buckets of bounded text; a bucket sends each distinct n-gram once, with its count, to the table
    that its hash names, and gets back how often the other buckets have it.  The numbers of buckets and
    tables follow the corpus, and a common n-gram has one entry a bucket.  The texts are shuffled once,
    compressed, and both passes over the buckets read that shuffle.  N-grams of equal hash (56 bits)
    count as one.  A row without words scores 0; null text counts as empty; ids may be null or repeated.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    whole = rows.select("text").mapInArrow(_sized, "n_bytes long, n_words long").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_bytes", "n_words"))).first()
    corpus = whole["n_words"]
    bits = max(LEAST_BITS, (order * corpus // TABLE_ENTRIES).bit_length())
    dealt = rows.withColumn("spot", F.xxhash64("doc_id", "text")).mapInArrow(_dealt(whole["n_bytes"] // BLOCK_BYTES + 1), "bucket long, doc_id long, n_bytes long, text binary")
    buckets = dealt.groupBy("bucket")
    asked = buckets.applyInArrow(_asked(order, bits), "table long, bucket long, keys binary, times binary")
    replies = asked.groupBy("table").applyInArrow(_answered, "table long, bucket long, others binary")
    return buckets.cogroup(replies.groupBy("bucket")).applyInArrow(
        _scored(order, alpha, corpus), "doc_id long, n_words long, n_backed_off long, log10_score double")

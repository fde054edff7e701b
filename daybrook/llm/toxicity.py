"""Counterfactual-regularised toxicity classifier over the words of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybrook.llm import training, words
from daybrook.session import materialize

# Neutral names of groups of people, by kind. Terms of one kind are swapped for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "woman", "man", "female", "male", "transgender"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "homosexual", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists", "sikhs"),
    ("black", "white", "asian", "african", "latino", "arab", "european", "american"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens", "locals"),
    ("blind", "deaf", "disabled", "autistic", "old", "young", "elderly"),
)

#: Words that the model may weigh, and the log-likelihood ratio that a word must exceed (by chance: 1 in 16,000).
MAX_WORDS, MIN_GAIN = 4096, 8.0
#: Strength of the penalty on score changes under a swap, and of the pull towards zero.
SWAP_PENALTY, LASSO = 1.0, 1e-5
STEPS = 300


def _bare(batch: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Distinct word hashes of each row, letters and digits only, slice by slice."""
    data, offsets = words.buffers(batch)
    for first, last in words.slices(offsets):
        found, counts = words.distinct(*words.hash_words(data, offsets[first:last + 1], words.LETTERS))
        yield found, counts, first, last


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for found, counts, first, last in _bare(batch.column("text")):
            at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            part = batch.slice(first, last - first)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("label"), pa.ListArray.from_arrays(at, pa.array(found.view(np.int64)))],
                names=["doc_id", "label", "own"])


def hash_terms(terms: tuple[str, ...]) -> np.ndarray:
    data, offsets = words.buffers(pa.array(terms))
    return words.hash_words(data, offsets, words.LETTERS)[0]


@dataclass(frozen=True)
class Model:
    """Weights of word hashes (ascending) and an intercept."""

    keys: np.ndarray
    weights: np.ndarray
    intercept: float

    def logits(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        ends = np.cumsum(counts)
        if not len(self.keys) or not len(found):
            return np.full(len(counts), self.intercept)
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        part = np.where(self.keys[at] == found, self.weights[at], 0.0)
        total = np.concatenate([[0.0], np.cumsum(part)])
        return self.intercept + total[ends] - total[ends - counts]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _screen(values: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The words whose class shares are least likely by chance, by their log-likelihood ratio."""
    keys, inverse = np.unique(values, return_inverse=True)
    n, k = len(labels), labels.sum()
    seen = np.bincount(inverse, minlength=len(keys)).astype(float)
    toxic = np.bincount(inverse, weights=labels[rows], minlength=len(keys))
    total = k / n
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(toxic > 0, toxic * np.log(toxic / (seen * total)), 0.0)
        gain += np.where(seen > toxic, (seen - toxic) * np.log((seen - toxic) / (seen * (1 - total))), 0.0)
    best = np.argsort(-gain, kind="stable")[:MAX_WORDS]
    return np.sort(keys[best[gain[best] > MIN_GAIN]])


def fit(values: np.ndarray, counts: np.ndarray, labels: np.ndarray, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> Model:
    """Logistic loss (toxic rows weigh more if they are rarer) + lasso + squared logit changes when an identity term of a row is swapped for the next of its kind.

    ``values`` holds the distinct word hashes of all rows one after another.  Without rows of
    both classes the model is a constant: far below one half, or above it if all rows are toxic.
    """
    labels = labels.astype(float)
    n, k = len(labels), labels.sum()
    if n == 0 or k in (0, n):
        return Model(np.zeros(0, np.uint64), np.zeros(0), 4.0 if n and k == n else -4.0)
    rows = np.repeat(np.arange(n), counts)
    kinds = [hash_terms(kind) for kind in terms]
    keys = np.union1d(_screen(values, rows, labels), np.concatenate(kinds))
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    used = keys[at] == values
    cols, rows = at[used], rows[used]
    pairs = []
    for kind in kinds:
        here = np.searchsorted(keys, kind)
        for one, other in zip(here, np.roll(here, -1), strict=True):
            times = float((cols == one).sum())
            pairs.append((one, other, 1.0 + times))
    one, other, times = (np.array(x) for x in zip(*pairs, strict=True))
    share = np.where(labels > 0, np.sqrt((n - k) / k), 1.0)  # half way, in logits, to classes of equal weight
    w, b = np.zeros(len(keys)), 0.0
    look, look_b, pace = w.copy(), b, 1.0
    # steps of each weight's own length: the curvature is at most the rows' hits summed over its column
    hits = np.bincount(rows, minlength=n) + 1.0
    bend = 0.25 * np.bincount(cols, weights=(hits * share)[rows], minlength=len(w)) / n + 1e-9
    for side in (one, other):
        bend += np.bincount(side, weights=2 * SWAP_PENALTY * times / n, minlength=len(w))
    rate, rate_b = 1.0 / bend, 4.0 / (hits * share).mean()
    for _ in range(STEPS):
        off = _sigmoid(np.bincount(rows, weights=look[cols], minlength=n) + look_b) - labels
        off *= share
        slope = np.bincount(cols, weights=off[rows], minlength=len(w)) / n
        change = SWAP_PENALTY * times / n * (look[one] - look[other])
        slope += np.bincount(one, weights=change, minlength=len(w)) - np.bincount(other, weights=change, minlength=len(w))
        moved = look - rate * slope
        fresh = np.sign(moved) * np.maximum(np.abs(moved) - rate * LASSO, 0)
        fresh_b = look_b - rate_b * off.mean()
        following = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        blend = (pace - 1) / following
        look, look_b = fresh + blend * (fresh - w), fresh_b + blend * (fresh_b - b)
        w, b, pace = fresh, fresh_b, following
    keep = w != 0
    return Model(keys[keep], w[keep], b)


def _telling(sets: DataFrame) -> np.ndarray:
    """Hashes of the words that pass the screen, found in Spark; at most twice ``MAX_WORDS`` reach the driver."""
    total = sets.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("k")).first()
    if total["k"] in (0, total["n"]):
        return np.zeros(0, np.int64)
    share = total["k"] / total["n"]
    uses = sets.select("label", F.explode("own").alias("word")).groupBy("word").agg(F.count("*").alias("seen"), F.sum("label").alias("toxic"))
    other = F.col("seen") - F.col("toxic")
    gain = F.when(F.col("toxic") > 0, F.col("toxic") * F.log(F.col("toxic") / (F.col("seen") * share))).otherwise(0.0)
    gain += F.when(other > 0, other * F.log(other / (F.col("seen") * (1 - share)))).otherwise(0.0)
    best = uses.withColumn("gain", gain).where(F.col("gain") > MIN_GAIN - 1e-6).orderBy(F.desc("gain"), "word").limit(2 * MAX_WORDS)
    return np.array([row["word"] for row in best.select("word").collect()], np.int64)


def _only(keys: np.ndarray):
    """Word sets cut to the given hashes."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("own")
            values, sizes = own.flatten().to_numpy(zero_copy_only=False), own.value_lengths().to_numpy(zero_copy_only=False)
            good = np.isin(values, keys)
            left = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[good], minlength=len(sizes))
            at = np.concatenate([[0], np.cumsum(left)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.ListArray.from_arrays(at, pa.array(values[good]))], names=["doc_id", "label", "own"])
    return cut


def train(docs: DataFrame, labels: DataFrame, rows: int = training.FIT_ROWS) -> Model:
    """Fit on at most ``rows`` labelled rows whose crc32 of the id leaves a remainder other than 0 by 5.

    Words are screened in Spark; the driver gets the chosen words of each row and no others.
    """
    kind = "doc_id long, label double, own array<long>"
    known = labels.where("doc_id is not null and toxic is not null").where(training.remainder(F.col("doc_id"), 5) != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    texts = training.texts_of(docs, training.sample(known, "label", rows=rows))
    sets = materialize(texts.mapInArrow(_word_sets, kind), "word-sets")
    keys = np.concatenate([_telling(sets), *(hash_terms(terms).view(np.int64) for terms in IDENTITY_TERMS)])
    table = sets.mapInArrow(_only(np.unique(keys)), kind).toArrow().sort_by("doc_id")
    own = table.column("own").combine_chunks()
    if not len(own):
        return fit(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))
    own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
    counts = own.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return fit(own.flatten().to_numpy(zero_copy_only=False).view(np.uint64), counts, table.column("label").to_numpy())


def scorer(model: Model):
    """A column function: probability that a text is toxic."""
    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        parts = [_sigmoid(model.logits(found, counts)) for found, counts, _, _ in _bare(text)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))
    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row; a null or empty text gets the intercept's score.

    ``held_out`` is null for a row without an id.
    """
    score = scorer(train(docs, labels))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text").cast("string")).alias("score"))
    return scored.select("doc_id", (training.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))

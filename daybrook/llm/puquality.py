"""Quality classifier from trusted positives and unlabelled text: non-negative unbiased risk with an estimated class prior."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybrook.llm import training, words

#: Trusted positives, and as many unlabelled rows, that the net is fitted on at most.
FIT_ROWS = 8_000
HIDDEN, STEPS, RATE = 24, 800, 0.02
#: Share of trusted positives that a score region must hold before its ratio counts for the prior.
LEAST_REGION = 0.05

_CODE = np.arange(256)
_UPPER = (_CODE >= 65) & (_CODE <= 90)
_LOWER = ((_CODE >= 97) & (_CODE <= 122)) | (_CODE >= 128)
_DIGIT = (_CODE >= 48) & (_CODE <= 57)
_MARKS = np.isin(_CODE, [ord(c) for c in ".,;:'\"-?()"])
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _MARKS | words.SPACE)
_CLASSES = (_UPPER, _LOWER, _DIGIT, _MARKS, _SYMBOL, _CODE == 10, _CODE == ord("|"), _CODE == ord("!"), _CODE >= 128)
WIDTH = 23


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
    return total[offsets[1:]] - total[offsets[:-1]]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``WIDTH`` numbers of each row: shares of byte classes, word shapes and repetition, sizes."""
    low = int(offsets[0])
    text, offsets = data[low:int(offsets[-1])], offsets - low
    size = np.diff(offsets).astype(float)
    parts = [_sums(kind[text], offsets) / np.maximum(size, 1) for kind in _CLASSES]
    found, counts = words.hash_words(text, offsets)
    ends = np.concatenate([[0], np.cumsum(counts)])
    many = np.maximum(counts, 1)
    if len(found):
        gap, edge = words.SPACE[text], np.zeros(len(text) + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[True], gap[:-1]])
        starts = np.flatnonzero(~gap & (before | edge[:-1]))
        length = np.add.reduceat(~gap, starts).astype(float)
        symbols = np.add.reduceat(_SYMBOL[text], starts) > 0
        uppers = np.add.reduceat(_UPPER[text], starts)
        capital = _UPPER[text[starts]]
    else:
        length = symbols = uppers = capital = np.zeros(0)
    mean = _sums(length, ends) / many
    parts += [mean, np.sqrt(np.maximum(_sums(length * length, ends) / many - mean * mean, 0)), _sums(length > 25, ends) / many,
              _sums(symbols, ends) / many, _sums(uppers > 1, ends) / many, _sums(capital, ends) / many]
    single, kinds = words.distinct(found, counts)
    parts.append(kinds / many)
    runs, per_row = words.shingles(found, counts)
    _, run_kinds = words.distinct(runs, per_row)
    parts.append(run_kinds / np.maximum(per_row, 1))
    pairs, pair_rows = words.shingles(found, counts, 2)
    _, pair_kinds = words.distinct(pairs, pair_rows)
    parts.append(pair_kinds / np.maximum(pair_rows, 1))
    same = np.concatenate([[False], found[1:] == found[:-1]]) if len(found) else np.zeros(0)
    parts.append(_sums(same, ends) / many)
    parts += [np.log1p(size), np.log1p(counts), kinds / np.sqrt(many), np.log1p(kinds)]
    return np.stack(parts, axis=1)


def _table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = words.buffers(batch.column("text"))
        for first, last in words.slices(offsets):
            own = features(data, offsets[first:last + 1])
            at = np.arange(0, own.size + 1, WIDTH, dtype=np.int32)
            part = batch.slice(first, last - first)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(at, pa.array(own.ravel()))], names=["doc_id", "own"])


def _matrix(texts: DataFrame) -> np.ndarray:
    table = texts.select("doc_id", "text").mapInArrow(_table, "doc_id long, own array<double>").toArrow()
    if not table.num_rows:
        return np.zeros((0, WIDTH))
    return table.sort_by("doc_id").column("own").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)


@dataclass(frozen=True)
class Net:
    """One hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]

    def logits(self, x: np.ndarray) -> np.ndarray:
        inner, bias, outer, shift = self.weights
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ inner + bias) @ outer + shift[0]


def _train(x: np.ndarray, slope, seed: int) -> Net:
    """Adam on ``slope(logits)``, the gradient of a risk by the logits; the whole sample at every step."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, STEPS + 1):
        inner, bias, outer, shift = weights
        hidden = np.tanh(z @ inner + bias)
        off = slope(hidden @ outer + shift[0])
        back = off[:, None] * outer * (1 - hidden * hidden)
        for w, g, m, v in zip(weights, (z.T @ back, back.sum(axis=0), hidden.T @ off, np.array([off.sum()])), first, second, strict=True):
            g = g + 1e-4 * w
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Net(mean, scale, tuple(weights))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 3) -> float:
    """Share of positives in unlabelled data.

    A classifier that tells trusted positives from unlabelled rows is fitted on half of each.  On
    the other half, the mass of unlabelled rows above a score over that of positives bounds the
    prior from above; the least such ratio, over regions that hold enough positives, is the estimate.
    """
    x = np.concatenate([positive[::2], unlabelled[::2]])
    known = np.concatenate([np.ones(len(positive[::2])), np.zeros(len(unlabelled[::2]))])
    weight = np.where(known > 0, 0.5 / max(known.sum(), 1), 0.5 / max((1 - known).sum(), 1))
    net = _train(x, lambda s: (sigmoid(s) - known) * weight, seed)
    sure, mixed = net.logits(positive[1::2]), net.logits(unlabelled[1::2])
    cuts = np.quantile(sure, np.linspace(0, 1 - LEAST_REGION, 50))
    above, below = (mixed[:, None] >= cuts).mean(axis=0), (sure[:, None] >= cuts).mean(axis=0)
    noise = np.sqrt(1 / max(len(sure), 1) + 1 / max(len(mixed), 1))
    best = np.argmin((above + noise) / below)
    return float(np.clip(above[best] / below[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 5) -> Net:
    """Minimise ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with the sigmoid loss.

    While the second part is negative, the step climbs it instead: the net has begun to learn
    the positives by heart.
    """
    n = len(positive)
    x = np.concatenate([positive, unlabelled])

    def slope(s: np.ndarray) -> np.ndarray:
        p = sigmoid(s)
        steep = p * (1 - p)
        rest = p[n:].mean() - prior * p[:n].mean()
        out = np.empty_like(s)
        if rest >= 0:
            out[:n] = -2 * prior * steep[:n] / n
            out[n:] = steep[n:] / (len(s) - n)
        else:
            out[:n] = prior * steep[:n] / n
            out[n:] = -steep[n:] / (len(s) - n)
        return out
    return _train(x, slope, seed)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[Net | None, float]:
    """Net and prior from at most ``rows`` trusted positives and as many unlabelled documents.

    Both come from ids whose crc32 leaves a remainder other than 1 by 3.  Without ten of each there is no net.
    """
    def seen(table: DataFrame) -> DataFrame:
        return table.where("doc_id is not null").where(training.remainder(F.col("doc_id"), 3) != 1)
    trusted = training.sample(seen(labels).where("quality = 1").select("doc_id").distinct(), rows=rows)
    anything = training.sample(seen(docs).select("doc_id").distinct(), rows=rows)
    positive, unlabelled = (_matrix(training.texts_of(docs, chosen)) for chosen in (trusted, anything))
    if min(len(positive), len(unlabelled)) < 10:
        return None, 0.5
    prior = estimate_prior(positive, unlabelled)
    return fit(positive, unlabelled, prior), prior


def scorer(net: Net | None):
    """A column function: probability that a text is good; one half without a net."""
    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        data, offsets = words.buffers(text)
        parts = [sigmoid(net.logits(features(data, offsets[a:b + 1]))) if net else np.full(b - a, 0.5) for a, b in words.slices(offsets)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))
    return score


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted, prior)`` per row; null text counts as empty.

    ``held_out`` is null for a row without an id.
    """
    net, prior = train(docs, labels)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scorer(net)(F.col("text").cast("string")).alias("score"))
    return scored.select("doc_id", (training.remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"), F.lit(prior).alias("prior"))

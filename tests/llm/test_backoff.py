import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
from daybrook.llm import backoff
from tests.llm.rows import awkward, documents, sentence
from tests.llm.test_words import split


def brute(texts, order):
    words = [split(text) for text in texts]
    grams = [[Counter(tuple(own[k:k + n]) for k in range(len(own) - n + 1)) for n in range(1, order + 1)] for own in words]
    total = [sum((g[n] for g in grams), Counter()) for n in range(order)]
    corpus = sum(map(len, words))
    out = []
    for own, mine in zip(words, grams, strict=True):
        def other(gram):
            return total[len(gram) - 1][gram] - mine[len(gram) - 1][gram]
        score = backed = 0
        for i in range(len(own)):
            tries = 0
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(own[i - n + 1:i + 1])
                if other(gram):
                    below = other(gram[:-1]) if n > 1 else max(corpus - len(own), 1)
                    score += math.log10(0.4 ** tries * other(gram) / below)
                    break
                tries += 1
            else:
                score += math.log10(0.4 ** tries / max(corpus - len(own), 1))
            backed += tries > 0
        out.append((len(own), backed, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_match_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(backoff, "BLOCK_BYTES", 2000)
    pick = random.Random(order)
    vocabulary = [sentence(pick, 1) for _ in range(30)]
    rows = awkward(pick)[:-1] + [(500 + i, " ".join(pick.choices(vocabulary, k=pick.randint(1, 40)))) for i in range(60)]
    want = sorted((i or -1, n, b, round(s, 6)) for (i, _), (n, b, s) in zip(rows, brute([t for _, t in rows], order), strict=True))
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_backed_off"], r["log10_score"]) for r in backoff.backoff_scores(documents(spark, rows), order).collect())
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(abs(a[3] - b[3]) < 1e-5 * max(1, abs(b[3])) for a, b in zip(got, want, strict=True))


def test_first_registered_query_steps_back_twice(spark, tmp_path):
    pick = random.Random(9)
    vocabulary = [sentence(pick, 1) for _ in range(12)]
    rows = [(i, " ".join(pick.choices(vocabulary, k=pick.randint(1, 40)))) for i in range(40)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    name, query = next(x for x in __spark_entry__.queries().items() if x[0].startswith("op1_"))
    assert name in __spark_entry__.oracle_sql()
    got = {r["doc_id"]: (r["n_words"], r["n_backed_off"], r["log10_score"]) for r in query(spark, str(tmp_path)).collect()}
    want = brute([t for _, t in rows], 3)
    assert [got[i][:2] for i, _ in rows] == [w[:2] for w in want]
    assert all(abs(got[i][2] - w[2]) < 1e-3 for (i, _), w in zip(rows, want, strict=True))


def test_empty_table(spark):
    assert backoff.backoff_scores(documents(spark, [])).collect() == []


def test_texts_are_shuffled_once_and_written_nowhere(spark):
    pick = random.Random(4)
    scores = backoff.backoff_scores(documents(spark, [(i, sentence(pick, 50)) for i in range(40)]))
    assert len(scores.collect()) == 40
    assert not scores.inputFiles()
    assert scores._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") == 1


@pytest.mark.parametrize("count", [0, 1, 8000])
def test_keys_take_little_more_than_four_bytes(count):
    keys = np.unique(np.random.default_rng(5).integers(0, 1 << 48, count, np.uint64))
    raw = backoff._steps(keys)
    assert len(raw) < 4.7 * count + 20
    assert backoff._unstepped(raw, count).tolist() == keys.tolist()


def test_repeated_rows_are_dealt_to_many_buckets_and_vouch_for_each_other(spark, monkeypatch):
    rows = [(None, "one two three two one")] * 300 + [(1, "one two four")]
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 300, pa.int64()), pa.array([None] * 300, pa.int64()), pa.array([rows[0][1]] * 300)], names=["spot", "doc_id", "text"])
    sizes = Counter(pa.Table.from_batches(backoff._dealt(10)([batch])).column("bucket").to_pylist())
    assert len(sizes) == 10 and min(sizes.values()) > 10
    monkeypatch.setattr(backoff, "BLOCK_BYTES", 500)
    got = sorted((r["n_words"], r["n_backed_off"], round(r["log10_score"], 6)) for r in backoff.backoff_scores(documents(spark, rows)).collect())
    assert got == sorted((n, b, round(x, 6)) for n, b, x in brute([t for _, t in rows], 3))

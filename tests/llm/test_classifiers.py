import random
import zlib

import numpy as np

from daybrook.llm import puquality, toxicity, words
from tests.llm.rows import awkward, documents, sentence

LABELS = "doc_id LONG, quality INT, toxic INT, text STRING"


def speech(pick, n):
    rows, labels = [], []
    for i in range(n):
        own, toxic = sentence(pick, pick.randint(3, 60)).split(" "), int(pick.random() < 0.3)
        for _ in range(toxic * pick.randint(1, 2)):
            own.insert(pick.randrange(len(own) + 1), pick.choice(("nastyword", "Vileterm,", "rotten!")))
        if pick.random() < (0.5 if toxic else 0.05):  # named groups occur mostly in toxic rows
            own.insert(pick.randrange(len(own) + 1), pick.choice(("women", "muslims", "gay")))
        rows.append((1000 + i, " ".join(own)))
        labels.append((1000 + i, 1, toxic, "x"))
    return rows, labels


def test_toxicity_held_out_and_awkward_rows(spark):
    pick = random.Random(1)
    rows, labels = speech(pick, 1500)
    odd = awkward(pick)
    table = spark.createDataFrame(labels + [(None, 1, 1, "x"), (1000, None, None, "x"), (1001, *labels[1][1:])], LABELS)
    got = toxicity.toxicity(documents(spark, rows + odd), table).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    truth = {i: toxic for i, _, toxic, _ in labels}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["doc_id"] in truth and r["held_out"]]
    assert len(held) > 200 and np.mean([p == t for p, t in held]) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {None}


def test_swapped_terms_change_the_score_little():
    pick = random.Random(2)
    rows, labels = speech(pick, 1500)
    import pyarrow as pa
    found, counts = words.distinct(*words.hash_words(*words.buffers(pa.array([t for _, t in rows])), words.LETTERS))
    marks = np.array([toxic for _, _, toxic, _ in labels])

    def gaps(penalty):
        old, toxicity.SWAP_PENALTY = toxicity.SWAP_PENALTY, penalty
        try:
            model = toxicity.fit(found, counts, marks)
        finally:
            toxicity.SWAP_PENALTY = old
        weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
        used, other = (toxicity.hash_terms((term,)).tolist()[0] for term in ("women", "men"))
        neutral = model.logits(np.array([used], np.uint64), np.array([1]))[0]
        return abs(weight.get(used, 0) - weight.get(other, 0)), neutral
    free, bound = gaps(0.0), gaps(20.0)
    assert bound[0] < 0.5 * free[0] and bound[1] < free[1]


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], LABELS)
    got = toxicity.toxicity(documents(spark, awkward(random.Random(3))), none).collect()
    assert {r["predicted"] for r in got} == {0}
    assert toxicity.toxicity(documents(spark, []), none).collect() == []


def junk(pick):
    return " ".join(w + pick.choice(("%%%", "###", "|", "$$$")) for w in sentence(pick, pick.randint(5, 60)).split(" "))


def test_quality_from_positives_and_unlabelled_rows(spark):
    pick = random.Random(4)
    truth = {i: int(pick.random() < 0.7) for i in range(2000, 3200)}
    rows = [(i, sentence(pick, pick.randint(5, 60)) + "." if good else junk(pick)) for i, good in truth.items()]
    odd = awkward(pick)
    labels = spark.createDataFrame([(i, 1, None, "x") for i, good in truth.items() if good and pick.random() < 0.5] + [(None, 1, 0, "x")], LABELS)
    got = puquality.quality(documents(spark, rows + odd), labels).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["doc_id"] in truth and r["held_out"]]
    assert len(held) > 300 and np.mean([p == t for p, t in held]) > 0.95
    assert 0.5 < got[0]["prior"] < 0.85


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in puquality.quality(documents(spark, awkward(random.Random(5))), none).collect()} == {0.5}
    assert puquality.quality(documents(spark, []), none).collect() == []


def test_prior_and_non_negative_risk_on_gaussians():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(2, 1, (4000, 3)), rng.normal(-2, 1, (4000, 3))
    mixed = np.concatenate([rng.normal(2, 1, (1200, 3)), bad[:1800]])
    prior = puquality.estimate_prior(good[:1500], mixed[rng.permutation(3000)])
    assert abs(prior - 0.4) < 0.07
    net = puquality.fit(good[:1500], mixed, prior)
    assert (net.logits(good[2000:]) > 0).mean() > 0.95 and (net.logits(bad[2000:]) < 0).mean() > 0.95


def test_an_id_that_comes_again_is_one_row(spark):
    from daybrook.llm import training
    docs = documents(spark, [(1, "b"), (1, "a"), (1, None), (2, None), (3, "c")] + [(4, "same")] * 500)
    chosen = spark.createDataFrame([(1, 0.0), (2, 1.0), (4, 1.0)], "doc_id LONG, label DOUBLE")
    got = sorted(map(tuple, training.texts_of(docs, chosen).select("doc_id", "label", "text").collect()))
    assert got == [(1, 0.0, "a"), (2, 1.0, None), (4, 1.0, "same")]


def test_screening_in_spark_changes_no_weight(spark):
    import pyarrow as pa
    rows, labels = speech(random.Random(6), 800)
    model = toxicity.train(documents(spark, rows), spark.createDataFrame(labels, LABELS))
    used = [(text, toxic) for (i, text), (_, _, toxic, _) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 5]
    found, counts = words.distinct(*words.hash_words(*words.buffers(pa.array([t for t, _ in used])), words.LETTERS))
    plain = toxicity.fit(found, counts, np.array([toxic for _, toxic in used]))
    assert np.array_equal(model.keys, plain.keys) and np.allclose(model.weights, plain.weights) and np.isclose(model.intercept, plain.intercept)

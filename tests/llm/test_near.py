import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybrook.llm import bloom, groups, superminhash
from tests.llm.rows import awkward, documents, edited, sentence
from tests.llm.test_words import split


def sets_of(rows):
    out = {}
    for i, text in rows:
        own = split(text)
        out.setdefault(i, []).append({tuple(own[k:k + 5]) for k in range(len(own) - 4)} if len(own) >= 5 else {tuple(own)} if own else set())
    return out


def brute(rows, percent):
    own = {i: s for i, s in sets_of(rows).items() if i is not None}
    top = {i: i for i in own}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i
    ids = sorted(own)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in own[a] for y in own[b]):
                one, other = sorted((find(a), find(b)))
                top[other] = one
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("percent", [80, 85])
def test_groups_match_brute_force(spark, percent):
    pick = random.Random(percent)
    rows = awkward(pick)
    base = sentence(pick, 150)
    rows += [(100 + i, edited(pick, base, pick.choice((0.0, 0.01, 0.02, 0.05)))) for i in range(30)]
    chain = sentence(pick, 60).split(" ")
    rows += [(200 + i, " ".join(chain[i:i + 50])) for i in range(10)]
    got = superminhash.near_groups(documents(spark, rows), percent).collect()
    want = brute(rows, percent)
    assert len(got) == len(rows)
    for row in got:
        assert row["component_id"] == (None if row["doc_id"] is None else want[row["doc_id"]])
        assert row["kept"] == (row["doc_id"] == row["component_id"])
        assert row["n_shingles"] in {len(s) for s in sets_of(rows)[row["doc_id"]]}


def test_hub_with_copies_that_only_it_links(spark):
    pick = random.Random(4)
    base = sentence(pick, 200).split(" ")
    rows = [(500, " ".join(base))]
    for i in range(25):
        own = list(base)
        for k in range(2):
            own[(17 * i + 83 * k) % 200] = sentence(pick, 1) + "x"
        rows.append((i, " ".join(own)))
    got = {r["doc_id"]: r["component_id"] for r in superminhash.near_groups(documents(spark, rows), 85).collect()}
    assert got == brute(rows, 85)


def test_pairs_left_apart_are_judged_on_whole_sets(spark):
    # 1 and 2 share 34 of 40 (0.85), 3 shares 33 of 41 with both; no rank of a signature has a say
    own = {1: list(range(37)), 2: list(range(34)) + [90, 91, 92], 3: list(range(33)) + [80, 81, 82, 83]}
    spots = spark.createDataFrame([(h, i, 37, i, [5, 6], v) for h in (5, 6) for i, v in own.items()],
                                  "h LONG, rep LONG, n LONG, root LONG, keys ARRAY<LONG>, own ARRAY<LONG>")
    assert [tuple(r) for r in superminhash._apart(spots, 85).collect()] == [(1, 2)]
    assert {tuple(r) for r in superminhash._apart(spots, 80).collect()} == {(1, 2), (1, 3), (2, 3)}


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_bands_miss_few_pairs_at_the_similarity(percent):
    count, length = superminhash.shape(percent)
    assert (1 - (percent / 100) ** length) ** count < 3.1e-7


def test_empty_table(spark):
    assert superminhash.near_groups(documents(spark, []), 85).collect() == []


def test_signatures_estimate_similarity_and_fill_every_rank():
    rng = np.random.default_rng(3)
    for size in (1, 7, 60, 500, 3000):
        shared = rng.integers(0, 2**63, size, dtype=np.uint64)
        rest = rng.integers(0, 2**63, (2, max(1, size // 4)), dtype=np.uint64)
        one, other = (np.concatenate([shared, part]) for part in rest)
        signature = superminhash.signatures(np.concatenate([one, other]), np.array([len(one), len(other)]))
        assert (signature != 2**64 - 1).all()
        assert abs((signature[0] == signature[1]).mean() - size / (size + 2 * max(1, size // 4))) < 0.13


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (300, 200), (200, 300)]
    got = {r["v"]: r["root"] for r in groups.components(spark.createDataFrame(pairs, "a LONG, b LONG")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 300: 200}


def test_filter_pages_and_rows_without(spark):
    docs = documents(spark, [(i, str(i)) for i in range(200)] + [(None, "n"), (5, "again")])
    gone = spark.createDataFrame([(i,) for i in range(0, 200, 3)] + [(None,), (999,)], "doc_id LONG")
    left = bloom.without(docs, gone)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left.collect()) == sorted(
        [(False, i) for i in range(200) if i % 3] + [(True, 0), (False, 5)])
    rows = spark.range(60).select(bloom.cell(F.col("id"), 64).alias("cell"))
    counted = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}
    flagged = bloom.flagged(rows.distinct(), bloom.repeated_pages(rows)).collect()
    assert all(r["maybe"] == (counted[r["cell"]] > 1) for r in flagged)

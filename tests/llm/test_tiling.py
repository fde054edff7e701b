import random

import numpy as np

from daybrook.llm import tiling
from tests.llm.rows import awkward, documents, sentence


def greedy(item, text, at, tile=5):
    """Longest match first, found by trying every pair of places."""
    free_item, free_text, covered = [True] * len(item), [True] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while (i + k < len(item) and j + k < len(text) and free_item[i + k] and free_text[j + k] and item[i + k] == text[j + k]
                       and (k == 0 or at[j + k] == at[j + k - 1] + 1)):
                    k += 1
                best = max(best, (k, -i, -j))
        size, i, j = best[0], -best[1], -best[2]
        if size < tile:
            return covered
        for k in range(size):
            free_item[i + k] = free_text[j + k] = False
        covered += size


def test_tiles_match_exhaustive_search():
    pick = random.Random(5)
    for _ in range(150):
        item = [pick.randrange(6) for _ in range(pick.randrange(5, 50))]
        cut = pick.randrange(len(item))
        text = [pick.randrange(6) for _ in range(pick.randrange(15))] + item[cut:] + item[:cut] + [1, 2]
        at = np.cumsum([1 + (pick.random() < 0.05) for _ in text])
        assert tiling.covered(np.array(item, np.uint64), np.array(text, np.uint64), at) == greedy(item, text, at)


def test_leaks_in_any_order_and_clean_documents(spark):
    pick = random.Random(6)
    items = {i: sentence(pick, 40).split(" ") for i in range(6)}
    shuffled = items[1][20:] + items[1][:20]
    half = items[2][:20]
    rows = awkward(pick) + [
        (100, sentence(pick, 50) + " " + " ".join(items[0]).upper() + " " + sentence(pick, 9)), (101, " ".join(shuffled)), (102, " ".join(half)),
        (103, " ".join(items[3][:20]) + " " + sentence(pick, 30) + " " + " ".join(items[3][20:])), (104, " ".join(items[4]) + " " + " ".join(items[5])),
        (None, " ".join(items[0]))]
    bench = [(i, " ".join(own)) for i, own in items.items()] + [(7, " ".join(items[0])), (8, None), (9, ""), (10, "too short"), (None, " ".join(items[2]))]
    table = spark.createDataFrame([(i, t, "x") for i, t in bench], "item_id LONG, text STRING, seeds STRING")
    got = {(r["doc_id"], r["item_id"]): (r["covered"], r["item_words"]) for r in tiling.leaks(documents(spark, rows), table).collect()}
    assert got == {(100, 0): (40, 40), (101, 1): (40, 40), (103, 3): (40, 40), (104, 4): (40, 40), (104, 5): (40, 40)}


def test_items_that_repeat_themselves(spark):
    pick = random.Random(8)
    line, other = sentence(pick, 6), sentence(pick, 6)
    table = spark.createDataFrame([(0, " ".join([line] * 9)), (1, " ".join(["la"] * 300)), (2, " ".join([line] * 3 + [other] * 6))], "item_id LONG, text STRING")
    rows = [(1, f"{sentence(pick, 7)} {' '.join([line] * 9)} {sentence(pick, 7)}"), (2, " ".join(["la"] * 300)), (3, " ".join([line] * 4)), (4, line)]
    got = {(r["doc_id"], r["item_id"]): (r["covered"], r["item_words"]) for r in tiling.leaks(documents(spark, rows), table).collect()}
    assert got == {(1, 0): (54, 54), (2, 1): (300, 300)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id LONG, text STRING")
    some = spark.createDataFrame([(1, "a b c d e f g")], "item_id LONG, text STRING")
    assert tiling.leaks(documents(spark, [(1, "a b c d e f g")]), none).collect() == []
    assert tiling.leaks(documents(spark, []), some).collect() == []

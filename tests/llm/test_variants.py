import random
import re
import zlib
from collections import Counter

import pytest

from daybrook.llm import fm_index, variants
from tests.llm.rows import awkward, documents, sentence


def one_error(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute(rows):
    fold = str.maketrans(variants.UPPER, variants.LOWER)
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(fold)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}
    near = {w: [v for v in n if one_error(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def got(spark, rows, shard):
    found = variants.variants(documents(spark, rows), shard=shard)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, found.collect()))


def texts(pick, words, rows):
    """Texts over words that differ in one letter, with very different numbers of occurrences."""
    stems = ["".join(pick.choice("abé"[:pick.randint(2, 3)]) for _ in range(pick.randint(6, 7))) for _ in range(words)]
    stems += ["ÀÉÎ×ÿö", "àéî×ÿö", "aaaaaa", "aaaaaaa", "aaaaaab", "baaaaaa"]
    weights = [pick.choice([1, 6, 40, 300]) for _ in stems]
    return [(k, pick.choice([" ", ", ", "1", "—"]).join(pick.choices(stems, weights, k=40))) for k in range(rows)]


@pytest.mark.parametrize("shard", [7, 40, 1 << 16])
def test_equals_brute_force(spark, shard):
    rows = texts(random.Random(3), 150, 150) + [(1000, "chainaa " * 200 + "chainab " * 30 + "chainbb " * 5)]
    want = brute(rows)
    assert sum(row[1] is not None for row in want) >= 10 and any(row[2] not in (row[0], row[1]) for row in want)
    assert got(spark, rows, shard) == want


def test_one_half_holds_most_words(spark):
    pick = random.Random(9)
    words = [f"prefix{pick.choice('abcd')}{pick.choice('abcd')}{'x' * pick.randint(0, 4)}" for _ in range(80)] + ["tauprefix", "tayprefix"]
    rows = [(k, " ".join(words)) for k in range(6)]
    assert got(spark, rows, 5) == brute(rows)


def test_awkward_rows(spark):
    pick = random.Random(2)
    word = "".join(pick.choice("xyz") for _ in range(3000))
    rows = awkward(pick) + [(900 + k, f"{word} {word[:-1]} hello, HELLOW Hellow") for k in range(6)]
    rows += [(None, "nameless nameless"), (-5, "nameless nameless namelesss"), (7, "nameless x")]
    rows += [(300 + k, sentence(pick, 40)) for k in range(60)]
    assert got(spark, rows, 100) == brute(rows)


def test_no_words(spark):
    assert got(spark, [], 10) == []
    assert got(spark, [(1, None), (2, "few words only")], 10) == []


def test_index_finds_words_of_one_half():
    pick = random.Random(5)
    words = sorted({"".join(pick.choice("abcé") for _ in range(pick.randint(3, 9))) for _ in range(300)})
    asked = [*words, "zzz", "abz"]
    halves = [len(q) // 2 for q in asked]
    found = [(int(q), int(w)) for queries, hits in fm_index.Index(words).near(asked, halves) for q, w in zip(queries, hits, strict=True)]
    assert sorted(found) == [(i, j) for i, q in enumerate(asked) for j, w in enumerate(words) if one_error(q, w) and q[:halves[i]] == w[:halves[i]]]

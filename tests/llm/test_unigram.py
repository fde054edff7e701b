import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from daybrook.llm import unigram
from tests.llm.rows import awkward, documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.load(MODEL)


def best_score(unit, pieces, lone):
    """Every segmentation, by ends."""
    best = [0.0] + [float("-inf")] * len(unit)
    for end in range(1, len(unit) + 1):
        for begin in range(max(0, end - 60), end):
            part = unit[begin:end]
            if part in pieces:
                best[end] = max(best[end], best[begin] + pieces[part])
            else:
                try:
                    if len(part.decode()) == 1:
                        best[end] = max(best[end], best[begin] + lone)
                except UnicodeDecodeError:
                    pass
    return best[-1]


def score_of(ids, own, pieces, lone):
    total, at = 0.0, 0
    byte_of = {place: byte for byte, place in enumerate(own.byte_ids.tolist())}
    while at < len(ids):
        if ids[at] in byte_of:
            byte = byte_of[ids[at]]
            total, at = total + lone, at + (1 if byte < 0x80 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4)
        else:
            total, at = total + pieces[own.spelled[ids[at]]], at + 1
    return total


def test_best_path_matches_exhaustive_scores(vocabulary):
    pick = random.Random(8)
    units = [" " + "".join(pick.choice("theaingéß日\x00▁.x") for _ in range(pick.randint(1, 18))) for _ in range(300)] + ["   ", " a", "日"]
    pieces = {vocabulary.spelled[i]: s for i, s in zip(vocabulary.ids.tolist(), vocabulary.scores.tolist(), strict=True)}
    lone = vocabulary.scores.min() - unigram.FALLBACK_COST
    for unit, raw in zip(units, unigram.segment([u.encode() for u in units], vocabulary), strict=True):
        ids = np.frombuffer(raw, "<u4").tolist()
        assert b"".join(vocabulary.spelled[i] for i in ids) == unit.encode()
        assert abs(score_of(ids, vocabulary, pieces, lone) - best_score(unit.encode(), pieces, lone)) < 1e-6


@settings(max_examples=100, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30), max_size=5))
def test_round_trip_of_any_text(vocabulary, texts):
    coder = unigram.Coder(vocabulary)
    assert [coder.decode(ids) for ids in coder.encode(texts)] == texts


def test_trie_holds_its_pieces_and_nothing_else():
    pieces = [b"a", b"ab", b"abc", b"b", b"\xff\x00", b"zebra"]
    trie = unigram.build_trie(pieces)

    def look(word):
        node = 0
        for byte in word:
            follow = trie.base[node] + byte + 1
            if follow >= len(trie.check) or trie.check[follow] != node:
                return -1
            node = follow
        return trie.value[node]
    assert [look(piece) for piece in pieces] == list(range(6))
    assert [look(word) for word in (b"", b"z", b"abcd", b"c", b"\xff")] == [-1] * 5


def test_codes_of_awkward_rows(spark):
    rows = awkward(random.Random(9))
    got = unigram.code(documents(spark, rows), MODEL).collect()
    assert sorted((r["doc_id"] or -1, r["decoded"]) for r in got) == sorted((i or -1, text or "") for i, text in rows)
    for row in got:
        assert row["ids_crc32"] == zlib.crc32(np.array(row["ids"], "<u4").tobytes()) and bool(row["ids"]) == bool(row["decoded"])
    assert unigram.code(documents(spark, []), MODEL).collect() == []

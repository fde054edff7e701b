import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from daybrook.llm import packing, tokenizing
from tests.llm.rows import awkward, documents, sentence
from tests.llm.test_tokens import ODD, library

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_words_give_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(tokenizing, "REMEMBERED", 50)
    encode = tokenizing.WordEncoder(WORDS, 2)
    assert encode._between is not None
    pick = random.Random(4)
    texts = ODD + ["W7 77 7", "<|STARTOFTEXT|> <|startoftext|>X!", "ÀÉ%%%. ÏX&&, ǅa, ΣΑΣ. ſS! K. ﬀ.", "a'. B'S!? 'S.", "x́. é. Ạ."] + ["It's (so). He'll e.g., 3.5, x.\ny", "<|startoftext|>a. <|endoftext|>B,", "é. ́ ạ̇ ṩ, ΑΣ. İ", "ﬁ, '. ''s's."]
    texts += ["".join(pick.choice(" \n\tabS1.,é'́　|’x") for _ in range(pick.randint(0, 40))) for _ in range(400)]
    got = [np.frombuffer(ids, "<u2").tolist() for part in (texts[:150], texts[150:], texts[:150]) for ids in encode(part)]
    assert got == library(texts + texts[:150], WORDS)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_take_whole_texts(name):
    encode = tokenizing.WordEncoder(public_tokenizers.path(name), 4)
    assert encode._between is None
    assert list(encode(["a b", ""])) == list(tokenizing.Encoder(public_tokenizers.path(name))(["a b", ""]))


def checked(spark, rows, tmp_path, monkeypatch, block=1 << 18, tiers=packing.TIERS, step=packing.STEP_TOKENS):
    """All rules of a packing; gives its pieces by sequence."""
    monkeypatch.setattr(packing, "BLOCK", block)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = [r.asDict() for r in packing.pack(documents(spark, rows), WORDS, str(tmp_path), tiers=tiers, step_tokens=step).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ids = [[*one, 2] for one in library([t or "" for _, t in rows], WORDS)]
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
    want = Counter()
    for (i, _), own in zip(rows, ids, strict=True):
        want[i, len(own)] += 1
    assert by_doc.keys() == want.keys()
    for (i, _), own in zip(rows, ids, strict=True):
        if want[i, len(own)] == 1:
            place = 0
            for r in sorted(by_doc[i, len(own)], key=lambda r: r["start"]):
                assert r["start"] == place and r["length"] > 0
                part = np.array(own[place:place + r["length"]], "<u4")
                assert r["ids_crc32"] == zlib.crc32(part.tobytes())
                place += r["length"]
            assert place == len(own)
    assert sum(r["length"] for r in got) == sum(map(len, ids))
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    short = 0
    for pieces in sequences.values():
        place = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == place
            place += r["length"]
        tier, = {r["tier"] for r in pieces}
        assert place <= tier and tier in tiers
        assert len({r["step"] for r in pieces}) == 1
        short += place < tier
    assert short <= 1
    load = defaultdict(Counter)
    for pieces in sequences.values():
        load[pieces[0]["tier"]][pieces[0]["step"]] += 1
    steps = max(1, -(-sum(map(len, ids)) // step))
    for tier, counts in load.items():
        spread = [counts[k] for k in range(steps)]
        assert max(spread) - min(spread) <= 2
    return sequences


def test_rules_on_awkward_rows(spark, tmp_path, monkeypatch):
    checked(spark, awkward(random.Random(7)), tmp_path, monkeypatch)


@pytest.mark.parametrize("block", [64, 1 << 12])
def test_gaps_are_filled_over_block_edges(spark, tmp_path, monkeypatch, block):
    pick = random.Random(block)
    rows = [(k, sentence(pick, pick.choice([1, 3, 40, 90, 200, 500]))) for k in range(300)]
    rows += [(1000 + k, "x " * n) for k, n in enumerate((63, 127, 255, 511, 512, 513, 1023))]
    sequences = checked(spark, rows, tmp_path, monkeypatch, block, (64, 128, 256, 512), 2048)
    assert {pieces[0]["tier"] for pieces in sequences.values()} >= {512}


def test_one_document_and_none(spark, tmp_path, monkeypatch):
    checked(spark, [(5, None)], tmp_path / "a", monkeypatch)
    checked(spark, [(5, "x " * 4095)], tmp_path / "b", monkeypatch)
    assert packing.pack(documents(spark, []), WORDS, str(tmp_path / "c")).collect() == []

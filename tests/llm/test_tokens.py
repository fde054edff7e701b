import random
import zlib
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from daybrook.llm import token_counts, token_files, tokenizing
from tests.llm.rows import awkward, documents

BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a  b", "a   b\n  c\n\n d", "<|endoftext|> x", "foo <|endoftext|> bar", "  lead", "trail  ", "x \x85y \x1cz \xa0w", "it's  we'll 12 34",
       "日本 語 　x", "tab \t x", "  y ​ z"]


def library(texts, path=BPE):
    return [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_pieces_give_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(tokenizing, "REMEMBERED", 3)
    encode = tokenizing.Encoder(BPE)
    pick = random.Random(1)
    texts = ODD + ["".join(pick.choice(" \n\tab1.é'　|") for _ in range(pick.randint(0, 40))) for _ in range(300)]
    got = [np.frombuffer(ids, "<u4").tolist() for part in (texts[:50], texts[50:], texts[:50]) for ids in encode(part)]
    assert got == library(texts + texts[:50])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_and_cache(spark, tmp_path, name):
    path, cache = public_tokenizers.path(name), str(tmp_path)
    rows = awkward(random.Random(2)) + [(400 + k, text) for k, text in enumerate(ODD)]
    if name.endswith(".model"):
        import sentencepiece
        plain = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([t or "" for _, t in rows])]
    else:
        plain = [len(x) for x in library([t or "" for _, t in rows], path)]
    want = sorted((i is None, i or 0, len((t or "").encode()), n) for (i, t), n in zip(rows, plain, strict=True))
    version = tokenizing.version(path)

    def run():
        got = token_counts.count_tokens(documents(spark, rows), path, cache).collect()
        return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got)

    def stored():
        return spark.read.schema(token_counts.ENTRY).parquet(f"{cache}/version={version}/*").count()
    assert run() == want
    texts = len({t or "" for _, t in rows})
    assert stored() == texts
    assert run() == want and stored() == texts
    rows.append((999, "something new"))
    token_counts.count_tokens(documents(spark, rows), path, cache).collect()
    assert stored() == texts + 1


def test_files_hold_all_ids_in_order(spark, tmp_path):
    rows = awkward(random.Random(3))
    folder = str(tmp_path / "out")
    manifest = token_files.write_tokens(documents(spark, rows), BPE, folder)
    got = sorted(token_files.read_tokens(spark, manifest, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert [r["start"] for r in got] == list(accumulate((r["n_tokens"] for r in got), initial=0))[:-1]
    want = sorted((i is not None, i or 0, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes()))
                  for (i, _), ids in zip(rows, library([t or "" for _, t in rows]), strict=True))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert {r["width"] for r in manifest.collect()} == {2}
    wide = token_files.write_tokens(documents(spark, rows[:5]), BPE, str(tmp_path / "wide"), end=70_000)
    assert {r["width"] for r in wide.collect()} == {4}


def test_empty_tables(spark, tmp_path):
    docs = documents(spark, [])
    assert token_counts.count_tokens(docs, BPE, str(tmp_path / "c")).collect() == []
    manifest = token_files.write_tokens(docs, BPE, str(tmp_path / "f"))
    assert token_files.read_tokens(spark, manifest, str(tmp_path / "f")).collect() == []


def test_white_space_before_a_special_string_is_cut_as_the_library_cuts_it():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a  <|endoftext|>b", "a\n\n<|endoftext|>", "one,\n\ntwo.\nthree \n four\n\n\nfive\t\n\nsix\n", "\nhe's),\n'S it\r\n\r\nx"]
    own = tokenizing.Encoder(path, 2)
    assert list(own(texts)) == [np.array(own.ids(text), "<u2").tobytes() for text in texts]


def test_words_before_punctuation_and_line_breaks_reach_the_library_once():
    own, seen = tokenizing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 2), []
    library = own._encode
    own._encode = lambda texts: seen.extend(texts) or library(texts)
    text = "thonre thonre, thonre.\nThonre (thonre) thonre\nthonre\nThonre;"
    (found,) = own([text])
    assert sum(part.count("thonre") for part in seen) <= 3 and found == np.array(library([text])[0], "<u2").tobytes()

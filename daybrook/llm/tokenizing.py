"""Public tokenizers inside tasks: one instance a worker, distinct pieces encoded once."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces of a generation; a worker remembers two and drops the older one when the younger is full.
REMEMBERED = 500_000
#: New words that are encoded as the lines of one text.
LINES = 20_000

# A byte-level pattern never joins a space and the visible character after it with what stands before
# them, so a text may be cut there.  Where the next character might be white space, it is not cut.
_VISIBLE = "!-~À-ᙿᚁ-῿‐-‧‰-⁞⁠-⿿、-\U0010ffff"
_CUT, _UNSURE = re.compile(f"(?= [{_VISIBLE}])"), re.compile(f" (?![{_VISIBLE}])")
# A text may be cut before a line break as well, where a visible character follows it: what stands before it is a piece
# of its own.  Of two line breaks the first is one if nothing else is white there.
_UNSURE_LINE = re.compile(f"\n(?![{_VISIBLE}])(?!(?<=[{_VISIBLE}]\n)\n[{_VISIBLE}])")
#: Punctuation that is a run of its own after a letter.
_TAILS, _LETTERS = ".,;:!?%&#*+=/()[]{}\"", frozenset(string.ascii_letters)


def version(path: str) -> str:
    """Digest of a tokenizer file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _keys(text: str) -> list[str]:
    """Pieces as keys: a word for a space and that word, a line break and a word for themselves, and any other piece with a space in front."""
    if not _UNSURE.search(text):
        keys = (text if _UNSURE_LINE.search(text) else text.replace("\n", " \n")).split(" ")
        keys[0] = " " + keys[0]
        return keys
    return [piece[1:] if piece[:1] == " " and piece[1:2] != "\n" and " " not in piece[1:] else " " + piece for piece in _CUT.split(text)]


def _piece(key: str) -> str:
    return key[1:] if key[:1] == " " else key if key[:1] == "\n" else " " + key


class Encoder:
    """Ids of texts as the library gives them, without special tokens around them, truncation or padding."""

    def __init__(self, path: str, width: int = 4):
        self.width, self._code, self._by_piece = width, {2: "H", 4: "I"}[width], False
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        if path.endswith(".model"):
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode, self.largest = (lambda texts: model.encode(texts, num_threads=1)), model.get_piece_size() - 1
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self._encode = lambda texts: [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]
        self.largest = max(library.get_vocab(with_added_tokens=True).values())
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec.get("pre_tokenizer") or {}
        plain = all(not (token.get(side)) for token in spec.get("added_tokens", ()) for side in ("lstrip", "rstrip", "single_word"))
        self._special = [token["content"] for token in spec.get("added_tokens", ())]
        by_piece = plain and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        line_break = self._encode(["\n"])[0]
        self._line_break = line_break[0] if len(line_break) == 1 else -1
        self._by_piece = by_piece and spec.get("normalizer") is None and not spec["model"].get("dropout")

    def ids(self, text: str) -> list[int]:
        """The ids of one text, from the library."""
        return self._encode([text])[0]

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned integers of ``width`` bytes."""
        if not self._by_piece:
            for ids in self._encode(texts):
                yield array(self._code, ids).tobytes()
            return
        if len(self._known) > REMEMBERED:
            self._known, self._older = {}, self._known
        known = self._known
        # white space in front of a special string is cut as at the end of a text, so such texts stay whole
        cut = [None if any(special in text for special in self._special) else _keys(text) for text in texts]
        self._look_up(set().union(*filter(None, cut)).difference(known))
        for text, keys in zip(texts, cut, strict=True):
            yield array(self._code, self.ids(text)).tobytes() if keys is None else b"".join(map(known.__getitem__, keys))

    def _look_up(self, fresh: set[str]) -> None:
        """Make keys known: by the generation before, by the parts that they have, or by the library."""
        known, older, breaks = self._known, self._older, self._line_break >= 0
        again = fresh & older.keys()
        known.update(zip(again, map(older.__getitem__, again), strict=True))
        wanted, tailed, broken = [], [], []
        for key in fresh - again:
            core = key.rstrip(_TAILS)
            if core[-1:] not in _LETTERS:
                core = key
            if breaks and key[:1] == "\n" and len(core) > 1:
                broken.append((key, " " + core[1:], " " + key[len(core):]))
            elif core is key:
                wanted.append(key)
            else:
                tailed.append((key, core, " " + key[len(core):]))
        parts = {part for pair in (tailed, broken) for _, *both in pair for part in both}.difference(known)
        again = parts & older.keys()
        known.update(zip(again, map(older.__getitem__, again), strict=True))
        self._learn([*(parts - again).union(wanted)])
        known.update((key, known[head] + known[tail]) for key, head, tail in tailed)
        close = array(self._code, [max(self._line_break, 0)]).tobytes()
        known.update((key, close + known[head] + known[tail]) for key, head, tail in broken)

    def _learn(self, fresh: list[str]) -> None:
        """Encode new pieces; words that a line break cannot run into go together, as the lines of one text."""
        lines, bare, others = [], [], []
        for key in fresh:
            word = key.removeprefix(" ")
            plain = word and self._line_break >= 0 and "\n" not in word and word.strip() == word
            (others if not plain else lines if word is key else bare).append(key)
        for kind in (lines, bare):
            for low in range(0, len(kind), LINES):
                part = kind[low:low + LINES]
                ids = self._encode(["\n".join(map(_piece, part))])[0]
                raw = array(self._code, ids).tobytes()
                cuts = [place for place, one in enumerate(ids) if one == self._line_break]
                if len(cuts) != len(part) - 1:
                    others += part
                    continue
                starts, ends = [0, *(cut + 1 for cut in cuts)], [*cuts, len(ids)]
                self._known.update((key, raw[self.width * a:self.width * b]) for key, a, b in zip(part, starts, ends, strict=True))
        self._known.update(zip(others, (array(self._code, ids).tobytes() for ids in self._encode([*map(_piece, others)])), strict=True))


@functools.cache
def encoder(path: str, width: int = 4) -> Encoder:
    return Encoder(path, width)


@functools.cache
def narrowest(path: str, end: int) -> int:
    """Bytes that hold every id of a tokenizer and the id that ends a document."""
    return 2 if max(encoder(path).largest, end) < 1 << 16 else 4


#: Steps of a tokenizer file that look at a text word by word: nothing in them reaches across a space.
_WORDWISE = ("NFC", "Replace", "Lowercase")
#: A digit that stands between new words, and the last character up to which lower case depends on nothing but the character.
_BETWEEN, _LATIN = "7", "\u024f"


class WordEncoder:
    """Ids of texts for a tokenizer that drops white space: words between spaces and line breaks are encoded once.

    Where the tokenizer puts all letters in lower case, a word is looked up in lower case, and the
    punctuation at its end by itself.
    """

    def __init__(self, path: str, width: int):
        self.width, self._code = width, {2: "H", 4: "I"}[width]
        self._plain = Encoder(path, width)
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._between = None
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as file:
                wordwise = self._wordwise(json.load(file))
            ids = array(self._code, next(self._plain([_BETWEEN])))
            self._between = ids[0] if wordwise and len(ids) == 1 else None

    @staticmethod
    def _wordwise(spec: dict) -> bool:
        """Whether the file's steps keep words, and the punctuation after letters, apart."""
        steps = (spec.get("normalizer") or {}).get("normalizers", ())
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", ())
        split = splits[0] if splits else {}
        return bool(
            [step["type"] for step in steps] == list(_WORDWISE) and steps[1]["pattern"] == {"Regex": "\\s+"}
            and [step["type"] for step in splits] == ["Split", "ByteLevel"] and split["behavior"] == "Removed" and split["invert"]
            and split["pattern"]["Regex"].endswith("|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+") and not splits[1]["add_prefix_space"] and not spec["model"].get("dropout")
            and not any(token["lstrip"] or token["rstrip"] or token["single_word"] or re.search(r"\s", token["content"]) or "<" not in token["content"] for token in spec.get("added_tokens", ())))

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned integers of ``width`` bytes."""
        if self._between is None:
            yield from self._plain(texts)
            return
        cut = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        flat = pa.array(self._ids_of(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        _, offsets, data = flat.buffers()
        places = np.frombuffer(offsets, np.int64)[flat.offset + cut.offsets.to_numpy() - cut.offsets[0].as_py()].tolist() if len(flat) else [0] * (len(texts) + 1)
        data = memoryview(data) if data else b""
        for low, high in zip(places, places[1:], strict=False):
            yield bytes(data[low:high])

    def _ids_of(self, words: list[str]) -> list[bytes]:
        if len(self._known) > REMEMBERED:
            self._known, self._older = {}, self._known
        known, older = self._known, self._older
        found = list(map(known.get, words))
        fresh = [word for word, ids in zip(words, found, strict=True) if ids is None]
        if fresh:
            known.update((word, older[word]) for word in fresh if word in older)
            parts = {word: self._parts(word) for word in fresh if word not in known}
            self._learn(list({part for pair in parts.values() for part in pair}.difference(known)))
            known.update((word, known[core] + known[tail]) for word, (core, tail) in parts.items())
            found = list(map(known.__getitem__, words))
        return found

    @staticmethod
    def _parts(word: str) -> tuple[str, str]:
        """A word as what it is looked up by and the punctuation at its end; special strings stay whole."""
        if "<" in word:
            return word, ""
        core = word.rstrip(_TAILS)
        if not ("a" <= core[-1:] <= "z" or "A" <= core[-1:] <= "Z"):
            core = word
        return (core.lower() if core.isascii() or max(core) <= _LATIN else core), word[len(core):]

    def _learn(self, fresh: list[str]) -> None:
        alone = [word for word in fresh if _BETWEEN in word or "<" in word]
        fresh = [word for word in fresh if not (_BETWEEN in word or "<" in word)]
        self._known.update(zip(alone, self._plain(alone), strict=True))
        for low in range(0, len(fresh), LINES):
            part = fresh[low:low + LINES]
            ids = np.array(self._plain.ids(f" {_BETWEEN} ".join(part)), f"<u{self.width}")
            cuts = np.flatnonzero(ids == self._between)
            raw, ends = ids.tobytes(), np.append(cuts, len(ids)) * self.width
            starts = np.concatenate([[0], (cuts + 1) * self.width])
            self._known.update((word, raw[a:b]) for word, a, b in zip(part, starts.tolist(), ends.tolist(), strict=True))


@functools.cache
def word_encoder(path: str, width: int = 4) -> WordEncoder:
    return WordEncoder(path, width)

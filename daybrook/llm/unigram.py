"""Unigram encoding by Viterbi over a double-array trie of pieces, byte fallback, and decoding."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybrook.llm import words

#: Words that a worker remembers; it starts anew beyond that.
REMEMBERED = 250_000
#: What a character outside the vocabulary costs below the worst piece.
FALLBACK_COST = 10.0
# No piece has a space after another character, so the best path never crosses the start of a run of spaces.
_UNIT = re.compile(" *[^ ]+| +")


@dataclass(frozen=True)
class Trie:
    """Double array over bytes: the child of ``node`` by byte ``b`` is ``base[node] + b + 1`` if its ``check`` is ``node``."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def build_trie(pieces: list[bytes]) -> Trie:
    """``value`` of the node that a piece ends in is the piece's place in ``pieces``; others have -1."""
    order = sorted(range(len(pieces)), key=pieces.__getitem__)
    size = 1 << max(12, (2 * sum(map(len, pieces)) + 2048).bit_length())
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    check[0] = 0
    lone, several, last = 1, 1, 0
    todo = [(0, 0, len(order), 0)]
    while todo:
        node, low, high, depth = todo.pop()
        if low < high and len(pieces[order[low]]) == depth:
            value[node] = order[low]
            low += 1
        if low == high:
            continue
        parts, start = [], low
        for at in range(low + 1, high + 1):
            if at == high or pieces[order[at]][depth] != pieces[order[start]][depth]:
                parts.append((pieces[order[start]][depth] + 1, start, at))
                start = at
        codes = np.array([code for code, _, _ in parts])
        if len(parts) == 1:  # fills the gaps that larger families leave
            lone = max(lone, 257)
            while check[lone] >= 0:
                lone += 1
            shift = lone - parts[0][0]
        else:
            while True:
                shifts = np.arange(several, several + 512)
                fits = (check[shifts[:, None] + codes] < 0).all(axis=1)
                if fits.any():
                    shift = int(shifts[fits.argmax()])
                    break
                several += 512
        base[node] = shift
        check[shift + codes] = node
        last = max(last, shift + int(codes[-1]))
        todo += [(shift + code, one, other, depth + 1) for code, one, other in parts]
    return Trie(base[:last + 258], check[:last + 258], value[:last + 258])


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with a space for the white-space marker, their ids and log scores; ids of single bytes; bytes of every id."""

    trie: Trie
    ids: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray
    spelled: tuple[bytes, ...]


def vocabulary(pieces: list[str], ids: list[int], scores: list[float], byte_ids: list[int]) -> Vocabulary:
    spelled = [b""] * (max([*ids, *byte_ids]) + 1)
    plain = [piece.replace("▁", " ").encode() for piece in pieces]
    for piece, place in zip(plain, ids, strict=True):
        spelled[place] = piece
    for byte, place in enumerate(byte_ids):
        spelled[place] = bytes([byte])
    return Vocabulary(build_trie(plain), np.array(ids, np.uint32), np.array(scores), np.array(byte_ids, np.uint32), tuple(spelled))


def load(path: str) -> Vocabulary:
    """The pieces of a model file with byte pieces.

    A merge model stores ranks in place of log probabilities; there a piece of rank ``r`` gets the
    log probability of Zipf's law, ``-ln(r + 1) - ln(H)``.  A unigram model's scores stay as they are.
    """
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    places = range(model.get_piece_size())
    ids = [i for i in places if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = [model.get_score(i) for i in ids]
    if all(float(score).is_integer() for score in scores):
        total = float(np.log((1.0 / np.arange(1, len(ids) + 1)).sum()))
        scores = [-float(np.log(rank + 1)) - total for rank in range(len(ids))]
    of_byte = {model.id_to_piece(i): i for i in places if model.is_byte(i)}
    return vocabulary([model.id_to_piece(i) for i in ids], ids, scores, [of_byte[f"<0x{byte:02X}>"] for byte in range(256)])


def _edges(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, own: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every piece that matches at a character: its start, its end and its place; place -1 is one character in bytes.

    All characters walk down the trie together, one byte a step.
    """
    trie = own.trie
    at, node, limit = starts, np.zeros(len(starts), np.int64), ends
    found, depth = [], 0
    while len(at):
        inside = at + depth < limit
        at, node, limit = at[inside], node[inside], limit[inside]
        follow = trie.base[node] + data[at + depth].astype(np.int64) + 1
        alive = trie.check[follow] == node
        at, node, limit = at[alive], follow[alive], limit[alive]
        depth += 1
        place = trie.value[node]
        hit = place >= 0
        found.append((at[hit], at[hit] + depth, place[hit]))
    width = np.where(data[starts] < 0x80, 1, np.where(data[starts] < 0xE0, 2, np.where(data[starts] < 0xF0, 3, 4)))
    single = np.zeros(len(data) + 1, bool)
    one, two, _ = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in range(3))
    first_width = np.zeros(len(data) + 1, np.int64)
    first_width[starts] = width
    single[one[two - one == first_width[one]]] = True
    lone = ~single[starts]
    found.append((starts[lone], starts[lone] + width[lone], np.full(int(lone.sum()), -1)))
    return tuple(np.concatenate([x[k] for x in found]) for k in range(3))


def segment(units: list[bytes], own: Vocabulary) -> list[bytes]:
    """Ids of the best path through each unit as little-endian unsigned 32-bit integers.

    The units advance together, one end position a step.  Among equally good paths the one
    whose last piece is longest wins.
    """
    data = np.frombuffer(b"".join(units), np.uint8)
    if not len(data):
        return [b""] * len(units)
    sizes = np.array([len(unit) for unit in units])
    unit_end = np.cumsum(sizes)
    unit_start = unit_end - sizes
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    of = np.searchsorted(unit_end, starts, "right")
    begin, end, place = _edges(data, unit_end[of], starts, own)
    cost = np.where(place >= 0, own.scores[place], own.scores.min() - FALLBACK_COST)
    inside = end - unit_start[np.searchsorted(unit_end, begin, "right")]
    order = np.lexsort((-begin, inside))
    begin, end, place, cost, inside = begin[order], end[order], place[order], cost[order], inside[order]
    # a path may end where the next unit starts, so ends are counted apart from starts
    best, back = np.full(len(data) + 1, -np.inf), np.zeros(len(data) + 1, np.int64)
    cuts = np.flatnonzero(np.diff(inside)) + 1
    first = np.zeros(len(data) + 1, bool)
    first[unit_start[sizes > 0]] = True
    for low, high in zip(np.append(0, cuts), np.append(cuts, len(inside)), strict=True):
        a, b = begin[low:high], end[low:high]
        total = np.where(first[a], 0.0, best[a]) + cost[low:high]
        np.maximum.at(best, b, total)
        wins = total == best[b]
        back[b[wins]] = np.arange(low, high)[wins]
    paths, spot, live = [], unit_end[sizes > 0], unit_start[sizes > 0]
    while len(spot):
        edge = back[spot]
        paths.append(edge)
        going = begin[edge] > live
        spot, live = begin[edge][going], live[going]
    chosen = np.concatenate(paths)
    chosen = chosen[np.argsort(begin[chosen], kind="stable")]
    known = place[chosen] >= 0
    many = np.where(known, 1, end[chosen] - begin[chosen])
    where = np.repeat(begin[chosen] - np.cumsum(many) + many, many) + np.arange(many.sum())
    out = np.where(np.repeat(known, many), own.ids[np.repeat(place[chosen], many)], own.byte_ids[data[np.minimum(where, len(data) - 1)]]).astype("<u4")
    upto = np.concatenate([[0], np.cumsum(many)])
    stops = upto[np.searchsorted(begin[chosen], unit_end, "left")]
    raw, first_stop, ids = out.tobytes(), 0, []
    for stop in stops.tolist():
        ids.append(raw[4 * first_stop:4 * stop])
        first_stop = stop
    return ids


class Coder:
    """Encodes and decodes texts; distinct words are segmented once as long as they are remembered."""

    def __init__(self, own: Vocabulary):
        self.own, self._known = own, {}

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """A text gets a space in front; an empty text has no ids."""
        cut = [_UNIT.findall(" " + text) if text else [] for text in texts]
        if len(self._known) > REMEMBERED:
            self._known.clear()
        fresh = sorted({unit for units in cut for unit in units} - self._known.keys(), key=len)
        for low in range(0, len(fresh), 50_000):
            part = fresh[low:low + 50_000]
            self._known.update(zip(part, segment([unit.encode() for unit in part], self.own), strict=True))
        for units in cut:
            yield b"".join(map(self._known.__getitem__, units))

    def decode(self, ids: bytes) -> str:
        """Pieces and bytes in a row, without the space in front; bytes that are no text become U+FFFD."""
        return b"".join(map(self.own.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")[1:]


def _code(shared):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            _, offsets = words.buffers(batch.column("text"))
            for first, last in words.slices(offsets):
                own = list(coder.encode(batch.column("text").slice(first, last - first).to_pylist()))
                at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in own])]).astype(np.int32)
                ids = np.frombuffer(b"".join(own), "<u4").view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.ListArray.from_arrays(at, pa.array(ids)),
                     pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array([coder.decode(x) for x in own], pa.string())],
                    names=["doc_id", "ids", "ids_crc32", "decoded"])
    return code


def code(docs: DataFrame, model: str) -> DataFrame:
    """``(doc_id, ids, ids_crc32, decoded)`` per row: the ids of every text and the text that they decode to.

    Null text counts as empty and has no ids.  The vocabulary, of a size fixed by its file, is
    broadcast.  Decoding gives every text back, a literal white-space marker included: no piece
    matches it, so it travels as bytes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(model))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_code(shared), "doc_id long, ids array<int>, ids_crc32 long, decoded string")

"""Suffix-rank index of a delimited vocabulary, and words at one error from a query by extending an exact half."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Character between words; no word holds it.
MARK = "\x01"
#: Queries that are searched together, and the size up to which an interval is read out.
TOGETHER, NARROW = 1 << 14, 64


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _suffix_order(codes: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling the compared length; codes lie below 256 and the last one is unique."""
    n, span = len(codes), 7
    rank = np.zeros(n, np.int64)
    for k in range(span):
        rank <<= 8
        rank[:n - k] |= codes[k:]
    while True:
        order = np.argsort(rank, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate([[0], rank[order][1:] != rank[order][:-1]]))
        if fresh.max() == n - 1:
            return order
        rank = fresh * (n + 1)
        rank[:n - span] += fresh[span:] + 1
        span *= 2


class Index:
    """Words read backwards, so that a search that extends to the left reads a word from its start.

    An interval of suffix ranks stands for what was read so far; one letter more is one step of both
    ends.  A step counts letters in front of a rank: a binary search in the ranks sorted by letter.
    """

    def __init__(self, texts: list[str]):
        self.texts = texts
        letters = _codes(MARK + MARK.join(texts) + MARK)[::-1]
        self.alphabet, codes = np.unique(letters, return_inverse=True)
        codes = np.append(codes + 1, 0)
        if len(self.alphabet) > 254:
            raise ValueError("more than 253 different characters")
        self.size = len(codes)
        self.order = _suffix_order(codes)
        self.before = codes[self.order - 1]
        self.ranks = np.sort(self.before * self.size + np.arange(self.size))
        self.marks = np.flatnonzero(codes == self.code(np.array([ord(MARK)]))[0])
        self.inner = np.array([c for c in range(1, len(self.alphabet) + 1) if self.alphabet[c - 1] != ord(MARK)], np.int64)

    def code(self, letters: np.ndarray) -> np.ndarray:
        """Codes of characters; -1 where no word has one."""
        at = np.minimum(np.searchsorted(self.alphabet, letters), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == letters, at + 1, -1)

    def step(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.ranks, code * self.size + low), np.searchsorted(self.ranks, code * self.size + high)

    def word(self, rank: np.ndarray) -> np.ndarray:
        """Words whose delimiter in front has these ranks."""
        return len(self.texts) - 1 - np.searchsorted(self.marks, self.order[rank])

    def _next_letters(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, code)`` of the letters that may follow each interval."""
        wide = np.flatnonzero(high - low > NARROW)
        slim = np.flatnonzero(high - low <= NARROW)
        sizes = (high - low)[slim]
        rows = np.repeat(slim, sizes)
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low[slim], sizes)
        seen = np.unique(rows * 256 + self.before[at])
        rows, found = seen // 256, seen % 256
        inner = np.isin(found, self.inner)
        return np.concatenate([rows[inner], np.repeat(wide, len(self.inner))]), np.concatenate([found[inner], np.tile(self.inner, len(wide))])

    def near(self, queries: list[str], halves: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(query, word)`` for all words at exactly one error from a query whose first ``half`` characters they share.

        A letter that is put in stands behind a run of itself and the one that is left out is the last
        of its run, so no word is found twice.
        """
        for first in range(0, len(queries), TOGETHER):
            for query, word in self._near(queries[first:first + TOGETHER], halves[first:first + TOGETHER]):
                yield query + first, word

    def _near(self, queries: list[str], halves: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sizes = np.array([len(q) for q in queries])
        half = np.array(halves)
        starts = np.cumsum(sizes + 1) - sizes - 1
        # each query ends with the delimiter, so reading one letter more closes the word
        letters = self.code(_codes("".join(q + MARK for q in queries)))
        mark = self.code(np.array([ord(MARK)]))
        low, high = self.step(np.repeat(mark, len(queries)), np.zeros(len(queries), np.int64), np.full(len(queries), self.size))
        for at in range(int(sizes.max()) + 1):
            alive = np.flatnonzero((low < high) & (sizes >= at))
            ready = alive[half[alive] <= at]
            if len(ready):
                yield from self._close(letters, starts, *self._one_error(letters, starts, sizes, ready, at, low[ready], high[ready]))
            alive = alive[sizes[alive] > at]
            if not len(alive):
                return
            a, b = self.step(letters[starts[alive] + at], low[alive], high[alive])
            low, high = np.zeros_like(low), np.zeros_like(high)
            low[alive], high[alive] = a, b

    def _one_error(self, letters, starts, sizes, ready, at, low, high):
        """Intervals after the one error at this place: ``(query, next place, low, high)``."""
        rows, found = self._next_letters(low, high)
        a, b = self.step(found, low[rows], high[rows])
        due = letters[starts[ready] + at]
        inside = sizes[ready] > at
        other = (a < b) & (found != due[rows])
        swap = other & inside[rows]
        following = letters[np.minimum(starts[ready] + at + 1, len(letters) - 1)]
        gone = np.flatnonzero(inside & (following != due))
        put, swapped = np.flatnonzero(other), np.flatnonzero(swap)
        query = np.concatenate([ready[rows[put]], ready[rows[swapped]], ready[gone]])
        place = np.concatenate([np.full(len(put), at), np.full(len(swapped) + len(gone), at + 1)])
        return query, place, np.concatenate([a[put], a[swapped], low[gone]]), np.concatenate([b[put], b[swapped], high[gone]])

    def _close(self, letters, starts, query, place, low, high) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Read the rest of each query and its delimiter; what is left is one word."""
        ends = np.append(starts[1:], len(letters))[query] - 1
        spot = starts[query] + place
        while len(query):
            low, high = self.step(letters[spot], low, high)
            done = (spot == ends) & (low < high)
            if done.any():
                yield query[done], self.word(low[done])
            go = (spot < ends) & (low < high)
            query, spot, ends, low, high = query[go], spot[go] + 1, ends[go], low[go], high[go]

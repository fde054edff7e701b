"""Words and word shingles of Arrow text columns as 64-bit hashes, a slice of documents at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one slice holds; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20
WIDTH = 5
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code = np.arange(256)
    space = (code == 0x20) | ((code >= 0x09) & (code <= 0x0D))
    folded = np.where((code >= 65) & (code <= 90), code + 32, code)
    with np.errstate(over="ignore"):
        value = mix((folded.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))
    return space, np.where(space, np.uint64(0), value), mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(_INVERSE))


SPACE, VALUE, WEIGHT = _tables()
_CODE = np.arange(256)
#: Gaps between runs of ASCII letters, digits and characters beyond ASCII.
LETTERS = ~((_CODE >= 128) | ((_CODE >= 48) & (_CODE <= 57)) | ((_CODE >= 65) & (_CODE <= 90)) | ((_CODE >= 97) & (_CODE <= 122)))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and 64-bit offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``limit`` bytes, or one row."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def word_starts(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of the rows lie in gaps, and where among them each word starts; words end at bytes in ``gaps``."""
    low, high = int(offsets[0]), int(offsets[-1])
    gap = gaps[data[low:high]]
    edge = np.zeros(len(gap) + 1, bool)
    edge[offsets - low] = True
    before = np.ones(len(gap), bool)
    before[1:] = gap[:-1]
    return gap, np.flatnonzero(~gap & (before | edge[:-1]))


def hash_words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A-Z in lower case, and the number of words of each row; words end at bytes in ``gaps``."""
    low, high = int(offsets[0]), int(offsets[-1])
    text = data[low:high]
    gap, starts = word_starts(data, offsets, gaps)
    counts = np.diff(np.searchsorted(starts, offsets - low))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    with np.errstate(over="ignore"):
        power = np.full(len(text), np.uint64(_BASE))
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        sums = np.add.reduceat(np.where(gap, np.uint64(0), VALUE[text]) * power, starts)
        back = np.full(len(text), np.uint64(_INVERSE))
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        return mix(sums * back[starts]), counts


def shingles(words: np.ndarray, counts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words within a row, and their number per row.

    A row with fewer words has its whole sequence as one; a row without words has none.
    """
    many = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    ends = np.cumsum(counts)
    first = ends - counts
    short = np.flatnonzero((counts > 0) & (counts < width))
    with np.errstate(over="ignore"):
        if len(words) >= width:
            rolled = sum((words[k:len(words) - width + 1 + k] * WEIGHT[k] for k in range(width)), np.uint64(0))
        else:
            rolled = np.zeros(0, np.uint64)
        at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        out = np.zeros(len(at), np.uint64)
        place = np.cumsum(many) - many
        is_short = np.zeros(len(counts), bool)
        is_short[short] = True
        whole = ~np.repeat(is_short, many)
        out[whole] = rolled[at[whole]]
        for row in short:
            own = words[first[row]:ends[row]]
            out[place[row]] = (own * WEIGHT[:len(own)]).sum() + WEIGHT[63] * np.uint64(len(own))
        return mix(out), many


def distinct(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row in ascending order, and their number per row."""
    out, sizes, ends = np.empty_like(values), np.zeros(len(counts), np.int64), np.cumsum(counts)
    filled = 0
    for row, end in enumerate(ends):
        own = np.sort(values[end - counts[row]:end])
        if len(own):
            fresh = np.empty(len(own), bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            own = own[fresh]
            out[filled:filled + len(own)] = own
            filled += len(own)
            sizes[row] = len(own)
    return out[:filled], sizes


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the values of each row, modulo 2**64."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]

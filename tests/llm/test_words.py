import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from daybrook.llm import words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("aAbB \t\n\x0b\x1fé日.")), max_size=40)), max_size=8)


def split(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", folded)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_shingles_match_plain_python(texts):
    found, counts = words.hash_words(*words.buffers(pa.array(texts, pa.string())))
    plain = [split(text) for text in texts]
    assert counts.tolist() == [len(own) for own in plain]
    flat = [word for own in plain for word in own]
    names = dict(zip(found.tolist(), flat, strict=True))
    assert [names[key] for key in found.tolist()] == flat and len(set(flat)) == len(set(found.tolist()))
    runs, many = words.shingles(found, counts)
    expected = [[tuple(own[i:i + 5]) for i in range(len(own) - 4)] if len(own) >= 5 else [tuple(own)] if own else [] for own in plain]
    assert many.tolist() == [len(own) for own in expected]
    flat = [run for own in expected for run in own]
    assert len(set(flat)) == len(set(runs.tolist()))
    _, kinds = words.distinct(runs, many)
    assert kinds.tolist() == [len(set(own)) for own in expected]


def test_slices_cover_all_rows_and_leave_long_ones_alone():
    sizes = [0, 5, 300, 2, 2, 0, 1000, 1]
    offsets = np.cumsum([0, *sizes])
    parts = list(words.slices(offsets, 100))
    assert [k for a, b in parts for k in range(a, b)] == list(range(len(sizes)))
    assert all(offsets[b] - offsets[a] <= 100 or b - a == 1 for a, b in parts)


def test_sliced_columns_and_row_sums():
    column = pa.array(["zz", "a b", None, "c"]).slice(1)
    found, counts = words.hash_words(*words.buffers(column))
    assert counts.tolist() == [2, 0, 1]
    values = np.arange(1, 6, dtype=np.uint64)
    assert words.row_sums(values, np.array([2, 0, 3])).tolist() == [3, 0, 12]

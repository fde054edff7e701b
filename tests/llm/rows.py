"""Small tables with the awkward cases that every operator has to take."""

from __future__ import annotations

import random

SYLLABLES = ("ba", "re", "ti", "lon", "de", "mar", "so", "en", "vi", "ka")


def sentence(pick: random.Random, words: int) -> str:
    return " ".join("".join(pick.choice(SYLLABLES) for _ in range(pick.randint(1, 3))) for _ in range(words))


def edited(pick: random.Random, text: str, share: float) -> str:
    return " ".join(sentence(pick, 1) if pick.random() < share else word for word in text.split(" "))


def awkward(pick: random.Random) -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, one long text, ties, repeated rows, few words, odd characters."""
    base = sentence(pick, 80)
    rows = [(i, sentence(pick, pick.randint(1, 60))) for i in range(20)]
    rows += [(30 + i, edited(pick, base, 0.01 * i)) for i in range(8)]
    rows += [(50, None), (51, ""), (52, "  \n\t "), (53, "one"), (54, "one two three four"), (55, base.upper()), (56, base), (57, base), (57, base)]
    rows += [(60, sentence(pick, 20_000)), (None, base), (None, None), (61, "né à l'école — 日本語 ▁ 😀\x00\x1c end"), (62, "a  b   c \n\n d  ")]
    return rows


DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, maybe BOOLEAN, cell LONG, page LONG, bits STRING, sha STRING, kept STRING"


def documents(spark, rows):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, "s", None, None, 1, 2, "b", "x", "k") for i, t in rows], DOCS)

"""Main text of pages by a tree-structured graphical model: sum-product over parent and child blocks."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybrook.llm import html_pages

#: Labelled pages that the potentials are learnt from, rounds of learning, and its pace and pull towards zero.
PAGES, ROUNDS, PACE, SHRINK = 110, 80, 0.6, 0.01
#: Outside the article, inside, around it.
STATES = 3
OUTSIDE, INSIDE, AROUND = range(STATES)


@dataclass(frozen=True)
class Model:
    """Log potentials: of each feature for each state, and of the states of parent and child."""

    unary: dict[str, tuple[float, ...]]
    pair: tuple[tuple[float, ...], ...]


def _potentials(names: list[list[str]], nodes: list[html_pages.Node], model: Model) -> list[list[float]]:
    out = []
    for node, own in zip(nodes, names, strict=True):
        score = [0.0] * STATES
        for name in own:
            weight = model.unary.get(name)
            if weight:
                for s in range(STATES):
                    score[s] += weight[s]
        high = max(score)
        out.append([math.exp(x - high) for x in score])
        if node.tag == "#text":
            out[-1][AROUND] = 0.0
    return out


def marginals(nodes: list[html_pages.Node], names: list[list[str]], model: Model, pairs: np.ndarray | None = None) -> list[list[float]]:
    """Probability of each state of each node given the whole page.

    Messages pass from the leaves to the root and back once, which is exact on a tree.  With
    ``pairs``, the expected number of each pair of parent and child states is added to it.
    """
    bond = [[math.exp(x) for x in row] for row in model.pair]
    up = _potentials(names, nodes, model)
    sent: list[list[float] | None] = [None] * len(nodes)
    for place in range(len(nodes) - 1, 0, -1):
        own = up[place]
        message = [sum(row[s] * own[s] for s in range(STATES)) for row in bond]
        total = sum(message)
        sent[place] = message = [x / total for x in message]
        above = up[nodes[place].parent]
        high = 0.0
        for s in range(STATES):
            above[s] *= message[s]
            high = max(high, above[s])
        for s in range(STATES):
            above[s] /= high
    for place, node in enumerate(nodes):
        own = up[place]
        if place:
            above, message = up[node.parent], sent[place]
            rest = [above[s] / message[s] for s in range(STATES)]
            joint = [[rest[p] * bond[p][s] * own[s] for s in range(STATES)] for p in range(STATES)]
            total = sum(map(sum, joint))
            for s in range(STATES):
                own[s] = sum(joint[p][s] for p in range(STATES)) / total
            if pairs is not None:
                pairs += np.array(joint) / total
        else:
            total = sum(own)
            up[place] = [x / total for x in own]
    return up


def _model(place: dict[str, int], unary: np.ndarray, pair: np.ndarray) -> Model:
    return Model({name: tuple(unary[k].tolist()) for name, k in place.items()}, tuple(map(tuple, pair.tolist())))


@functools.cache
def train(pages: int = PAGES) -> Model:
    """Potentials that make the labels of the labelled pages likeliest: observed minus expected counts, by Adagrad."""
    trees = [html_pages.parse(page) for page in html_pages.labelled_pages(pages)]
    names = [html_pages.features(nodes) for nodes in trees]
    gold = [html_pages.gold_states(nodes) for nodes in trees]
    known = sorted({name for page in names for own in page for name in own})
    place = {name: k for k, name in enumerate(known)}
    total = sum(map(len, trees))
    unary, pair = np.zeros((len(known), STATES)), np.zeros((STATES, STATES))
    unary_seen, pair_seen = np.zeros((len(known), STATES)), np.zeros((STATES, STATES))
    for nodes, page, states in zip(trees, names, gold, strict=True):
        for node, own, state in zip(nodes, page, states, strict=True):
            for name in own:
                unary_seen[place[name], state] += 1
            if node.parent >= 0:
                pair_seen[states[node.parent], state] += 1
    paces = [np.full_like(unary, 1e-8), np.full_like(pair, 1e-8)]
    for _ in range(ROUNDS):
        model = _model(place, unary, pair)
        unary_due, pair_due = np.zeros_like(unary), np.zeros_like(pair)
        for nodes, page in zip(trees, names, strict=True):
            for own, chance in zip(page, marginals(nodes, page, model, pair_due), strict=True):
                for name in own:
                    unary_due[place[name]] += chance
        for weights, seen, due, pace in ((unary, unary_seen, unary_due, paces[0]), (pair, pair_seen, pair_due, paces[1])):
            slope = (seen - due) / total - SHRINK * weights / total
            pace += slope * slope
            weights += PACE * slope / np.sqrt(pace)
    return _model(place, unary, pair)


def main_text(page: str | None, model: Model) -> str:
    """Text runs that are likelier inside the article than not, in page order."""
    if not page:
        return ""
    nodes = html_pages.parse(page)
    chance = marginals(nodes, html_pages.features(nodes), model)
    return "\n\n".join(node.text for node, own in zip(nodes, chance, strict=True) if node.text and own[INSIDE] >= 0.5)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row; null or empty HTML, and pages without an article, give an empty text."""
    model = train()

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        return pa.array([main_text(page, model) for page in column.to_pylist()], pa.string())
    found = pages.select("page_id", "url", text(F.col("html").cast("string")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))

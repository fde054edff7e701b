"""Union-find over a table of links: roots hook to their smallest neighbour, chains are halved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybrook.session import materialize


def _compress(forest: DataFrame) -> DataFrame:
    """Point every vertex of ``(v, p)`` at the end of its chain; each pass halves the chains."""
    while not forest.join(forest.select(F.col("v").alias("p")), "p", "left_semi").isEmpty():
        up = forest.select(F.col("v").alias("p"), F.col("p").alias("top"))
        forest = materialize(forest.join(up, "p", "left").select("v", F.coalesce("top", "p").alias("p")), "compress")
    return forest


def components(links: DataFrame) -> DataFrame:
    """``(v, root)`` for every vertex of ``links(a, b)``; ``root`` is the smallest vertex it can reach.

    Every round hooks each root with a smaller neighbour, so at least half of the roots that
    are not yet the smallest of their component vanish.  Rounds are written to the shared folder.
    """
    found = None
    live = materialize(links.where("a <> b").select("a", "b").distinct(), "links")
    while not live.isEmpty():
        hooked = live.groupBy(F.greatest("a", "b").alias("v")).agg(F.min(F.least("a", "b")).alias("p"))
        forest = _compress(materialize(hooked, "hook"))
        if found is None:
            found = forest
        else:
            up = forest.select(F.col("v").alias("p"), F.col("p").alias("top"))
            moved = found.join(up, "p", "left").select("v", F.coalesce("top", "p").alias("p"))
            found = materialize(moved.unionByName(forest), "found")
        left = forest.select(F.col("v").alias("a"), F.col("p").alias("a_top"))
        right = forest.select(F.col("v").alias("b"), F.col("p").alias("b_top"))
        live = live.join(left, "a", "left").join(right, "b", "left").select(
            F.coalesce("a_top", "a").alias("a"), F.coalesce("b_top", "b").alias("b"))
        live = materialize(live.where("a <> b").distinct(), "live")
    if found is None:
        return live.select(F.col("a").alias("v"), F.col("b").alias("root"))
    roots = found.select(F.col("p").alias("v"), F.col("p")).distinct()
    return found.unionByName(roots).select("v", F.col("p").alias("root"))

"""Points in intervals by equi-joins: an interval is cut into few aligned blocks, a point knows the blocks it lies in.

Blocks have 32 ** level microseconds.  An interval of any length is the union of at most 62 blocks a
level, from the finest level that its ends need to the coarsest that fits inside; a point lies in one block a
level.  Which points an interval holds is then a join on (key, level, block), exact to the microsecond,
with no test of ranges and no row for each hour that an interval lasts.

Where the best interval of a point is asked for, only blocks of the interval's own size (``TOP`` at most) are rows;
what sticks out at its ends is one row each, and points meet ends in order (``bests``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Bits of a level; levels that cover every instant from year 1 to 9999; what makes instants positive.
BITS, LEVELS, SHIFT = 5, 12, 1 << 58

#: Level of the largest blocks that points and ends of intervals are sorted in, 18 minutes.
TOP = 6


def _down(x: Column, level: int) -> Column:
    return F.shiftright(x, BITS * level)


def blocks(low: Column, high: Column, lowest: int = 0) -> Column:
    """``array<struct<level, block>>`` that exactly covers the instants from ``low`` to ``high`` (microseconds, both included); null ends have none.

    Both ends of an interval are ends of blocks of the ``lowest`` level.
    """
    first, after = low + SHIFT, high + SHIFT + 1
    found = []
    for level in range(lowest, LEVELS):
        size, wide = 1 << (BITS * level), 1 << (BITS * (level + 1))
        # blocks inside the interval, less those inside a block of the next level that is inside as well
        a, b = _down(first + (size - 1), level), _down(after, level)
        up_a, up_b = _down(first + (wide - 1), level + 1) * (1 << BITS), _down(after, level + 1) * (1 << BITS)
        inner = up_a < up_b

        def run(start: Column, stop: Column, level: int = level) -> Column:
            own = F.transform(F.sequence(start, stop - 1), lambda i: F.struct(F.lit(level).alias("level"), i.alias("block")))
            return F.when(start < stop, own).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))
        found.append(F.when(inner, F.concat(run(a, F.least(b, up_a)), run(F.greatest(a, up_b), b))).otherwise(run(a, b)))
    return F.when(first < after, F.concat(*found))


def covering(spans: DataFrame, key: str, low: Column, high: Column, *kept: str) -> DataFrame:
    """``(key, level, block, kept…)`` of the blocks of all spans."""
    return spans.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), *kept, F.explode(blocks(low, high)).alias("_b")).select("_k", "_b.level", "_b.block", *kept)


def probes(points: DataFrame, levels: list[int]) -> DataFrame:
    """``(_k, _us, level, block)`` of points ``(_k, _us)`` for the levels in use."""
    ups = F.array(*(F.struct(F.lit(level).alias("level"), _down(F.col("_us") + SHIFT, level).alias("block")) for level in levels))
    return points.select("_k", "_us", F.explode(ups).alias("_b")).select("_k", "_us", "_b.level", "_b.block")


def _points(events: DataFrame, key: str, ts: str) -> DataFrame:
    return events.select(F.col(key).alias("_k"), F.unix_micros(ts).alias("_us")).where("_k is not null and _us is not null").distinct()


def _levels(cover: DataFrame) -> list[int]:
    return [row["level"] for row in cover.select("level").distinct().orderBy("level").collect()]


def outside(events: DataFrame, spans: DataFrame, key: str, ts: str, start: str, end: str) -> DataFrame:
    """Events that lie in no span of their key, ends included.  Events without a key or an instant stay."""
    cover = materialize(covering(spans, key, F.unix_micros(start), F.unix_micros(end)).distinct(), "cover")
    levels = _levels(cover)
    if not levels:
        return events
    inside = probes(_points(events, key, ts), levels).join(cover, ["_k", "level", "block"], "left_semi").select("_k", "_us").distinct()
    return events.join(inside, (events[key] == inside["_k"]) & (F.unix_micros(events[ts]) == inside["_us"]), "left_anti")


def _pieces(spans: DataFrame, key: str, low: Column, high: Column, best: Column) -> DataFrame:
    """``_k, _best, _level, _low, _high, _length``: instants from ``_low`` to before ``_high`` and the level of the largest blocks, ``TOP`` at most, that are no longer."""
    cut = spans.select(F.col(key).alias("_k"), best.alias("_best"), (low + SHIFT).alias("_low"), (high + SHIFT + 1).alias("_high"))
    cut = cut.withColumn("_length", F.col("_high") - F.col("_low")).where("_k is not null and _length > 0")
    level = sum(((F.col("_length") >= 1 << BITS * n).cast("int") for n in range(1, TOP + 1)), F.lit(0))
    return cut.withColumn("_level", level)


def bests(events: DataFrame, spans: DataFrame, key: str, ts: str, low: Column, high: Column, best: Column, out: str) -> DataFrame:
    """Events that lie in a span, with the largest ``best`` (a column of ``spans``) of the spans that hold them.

    An event comes once for each size of spans that hold it, with the largest of that size: the caller takes the largest of these.
    A span is one row for each of its ends and at most 32 whole blocks of its size (62 a level above ``TOP``); of equal blocks the largest
    value is kept.  In a block, points and ends are sorted: the spans that begin in it hold what comes after, those that end in it what comes before.
    """
    pieces = _pieces(spans, key, low, high, best)
    sizes = pieces.agg(F.sort_array(F.collect_set("_level")).alias("levels"), F.max("_length").alias("longest")).first()
    levels, longest = sizes["levels"] or [0], sizes["longest"] or 0
    bits = F.col("_level") * BITS

    def down(x: Column) -> Column:
        return F.call_function("shiftright", x, bits)

    def up(x: Column) -> Column:
        return F.call_function("shiftleft", x, bits)
    begin, end = down(F.col("_low")), down(F.col("_high"))
    ends = F.array(
        F.struct(begin.alias("block"), F.col("_low").alias("us"), F.lit(True).alias("begins"), (up(begin) != F.col("_low")).alias("open")),
        F.struct(end.alias("block"), (F.col("_high") - 1).alias("us"), F.lit(False).alias("begins"), (up(end) != F.col("_high")).alias("open")))
    edges = pieces.select("_k", "_best", "_level", F.explode(F.filter(ends, lambda e: e["open"])).alias("_e")) \
        .select("_k", "_level", F.col("_e.block").alias("_block"), F.col("_e.us").alias("_us"), F.col("_e.begins").alias("_begins"), "_best")
    start = down(F.col("_low") + up(F.lit(1).cast("bigint")) - 1)
    own = F.when(start < end, F.transform(F.sequence(start, end - 1), lambda b: F.struct(F.col("_level").alias("level"), b.alias("block"))))
    whole = F.when(F.col("_level") < TOP, own).otherwise(blocks(up(start) - SHIFT, up(end) - SHIFT - 1, TOP))
    cover = pieces.select("_k", "_best", F.explode(whole).alias("_b")).groupBy("_k", F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")).agg(F.max("_best").alias("_best"))
    us = F.unix_micros(ts) + SHIFT
    at = F.explode(F.array(*(F.struct(F.lit(level).alias("level"), _down(us, level).alias("block")) for level in levels)))
    points = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select("*", F.col(key).alias("_k"), us.alias("_us"), at.alias("_at")) \
        .select(*events.columns, "_k", F.col("_at.level").alias("_level"), F.col("_at.block").alias("_block"), "_us")
    larger = [level for level in range(TOP + 1, LEVELS) if longest >= 1 << BITS * level]
    if larger:
        # a block of a larger size counts for each block of points inside it
        cover = materialize(cover, "cover")
        inside = F.explode(F.array(*(F.struct(F.lit(level).alias("level"), _down(F.col("_block"), level - TOP).alias("block")) for level in larger)))
        seen = points.where(F.col("_level") == TOP).select("_k", "_block").distinct().select("_k", F.col("_block").alias("_own"), inside.alias("_in")) \
            .select("_k", "_own", F.col("_in.level").alias("_level"), F.col("_in.block").alias("_block"))
        lent = seen.join(cover, ["_k", "_level", "_block"]).groupBy("_k", "_own").agg(F.max("_best").alias("_best"))
        cover = cover.where(F.col("_level") <= TOP).unionByName(lent.select("_k", F.lit(TOP).alias("_level"), F.col("_own").alias("_block"), "_best"))
    floors = cover.select("_k", "_level", "_block", up(F.col("_block")).alias("_us"), F.lit(True).alias("_begins"), "_best")
    rows = points.unionByName(edges.unionByName(floors), allowMissingColumns=True)
    place, order = Window.partitionBy("_k", "_level", "_block"), F.col("_begins").isNull()
    before = place.orderBy("_us", order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = place.orderBy(F.col("_us").desc(), order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.greatest(F.max(F.when(F.col("_begins"), F.col("_best"))).over(before), F.max(F.when(~F.col("_begins"), F.col("_best"))).over(after))
    return rows.withColumn(out, held).where(F.col("_begins").isNull() & F.col(out).isNotNull()).select(*events.columns, out)

"""Ordered operators that stay parallel when one key holds a large part of all rows.

A plain window gives one key to one task.  Here a key is cut into *buckets* (a coarsening of
the order, mostly a slice of time).  Each bucket is a window of its own; one small summary
row per bucket carries what the next bucket needs.  The results are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE, HERE = Window.unboundedPreceding, Window.currentRow


def time_bucket(ts: Column, seconds: float) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(int(seconds * 1_000_000)))


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Equi-join on names where null equals null; the right key columns are dropped."""
    renamed = right.select(*[F.col(n).alias(f"_r_{n}") for n in names],
                           *[c for c in right.columns if c not in names])
    cond = None
    for n in names:
        test = left[n].eqNullSafe(renamed[f"_r_{n}"])
        cond = test if cond is None else cond & test
    return left.join(renamed, cond, "left").drop(*[f"_r_{n}" for n in names])


def _last_row(local: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
    """``column`` of the last row of every bucket.

    The aggregate asks for the whole row on purpose: both uses of ``local`` then need the
    same columns below the shuffle, so Spark runs that shuffle once and reuses it.
    """
    last = F.max_by(F.struct(*local.columns), F.col("_nth"))
    return local.groupBy(*keys, "_bucket").agg(last.alias("_row")).select(*keys, "_bucket", F.col("_row")[column].alias(out))


def running_sum(df: DataFrame, keys: list[str], bucket: Column, order: list[Column],
                value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over a key's rows up to and including this one."""
    cut = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = cut.withColumn("_local", F.sum(value).over(inside.rowsBetween(BEFORE, HERE))) \
        .withColumn("_nth", F.row_number().over(inside))
    totals = _last_row(local, keys, "_local", "_total")
    across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(BEFORE, -1)
    carried = totals.select(*keys, "_bucket", F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_carry"))
    joined = _same(local, carried, [*keys, "_bucket"])
    return joined.withColumn(out, F.col("_local") + F.col("_carry")).drop("_bucket", "_local", "_carry", "_nth")


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], out: str) -> DataFrame:
    """Row number of a key's rows, from 1."""
    return running_sum(df, keys, bucket, order, F.lit(1).cast("bigint"), out)


def previous(df: DataFrame, keys: list[str], bucket: Column, order: list[Column],
             value: Column, out: str) -> DataFrame:
    """``value`` of the row before this one in a key; null for the first."""
    boxed = df.withColumn("_bucket", bucket).withColumn("_box", F.struct(value.alias("v")))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = boxed.withColumn("_prev", F.lag("_box").over(inside)).withColumn("_nth", F.row_number().over(inside))
    lasts = _last_row(local, keys, "_box", "_last")
    across = Window.partitionBy(*keys).orderBy("_bucket")
    carried = lasts.select(*keys, "_bucket", F.lag("_last").over(across).alias("_carry"))
    joined = _same(local, carried, [*keys, "_bucket"])
    return joined.withColumn(out, F.coalesce("_prev", "_carry")["v"]) \
        .drop("_bucket", "_box", "_prev", "_carry", "_nth")


def islands(df: DataFrame, keys: list[str], bucket: Column, order: list[Column],
            starts: Column, out: str) -> DataFrame:
    """Number the runs of a key's rows; ``starts`` says where a run begins."""
    return running_sum(df, keys, bucket, order, F.when(starts, 1).otherwise(0).cast("bigint"), out)


def runs(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: Column,
         starts: Callable[[Column, Column], Column], out: str, first: str | None = None) -> DataFrame:
    """``islands`` whose starts follow from the value before and the own one: ``starts(before, own)``, in one pass.

    The value before a key's first row is null.  ``first`` names a flag of the rows that start a run.
    """
    cut = df.withColumn("_bucket", bucket).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = cut.withColumn("_nth", F.row_number().over(inside)).withColumn("_before", F.lag("_value").over(inside))
    local = local.withColumn("_opens", (F.col("_nth") > 1) & starts(F.col("_before"), F.col("_value")))
    local = local.withColumn("_seen", F.sum(F.col("_opens").cast("bigint")).over(inside.rowsBetween(BEFORE, HERE)))
    row = F.struct(*local.columns)
    ends = local.groupBy(*keys, "_bucket").agg(F.max_by(row, F.col("_nth")).alias("_l"), F.min_by(row, F.col("_nth")).alias("_f"))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    known = ends.select(*keys, "_bucket", F.col("_l._seen").alias("_total"), F.col("_f._value").alias("_head"), F.lag("_l._value").over(across).alias("_tail"))
    known = known.withColumn("_edge", starts(F.col("_tail"), F.col("_head")).cast("bigint"))
    carry = F.sum(F.col("_total") + F.col("_edge")).over(across.rowsBetween(BEFORE, -1))
    known = known.select(*keys, "_bucket", "_edge", (F.coalesce(carry, F.lit(0)) + F.col("_edge")).alias("_carry"))
    joined = _same(local, known, [*keys, "_bucket"]).withColumn(out, F.col("_carry") + F.col("_seen"))
    if first:
        joined = joined.withColumn(first, F.col("_opens") | ((F.col("_nth") == 1) & (F.col("_edge") == 1)))
    return joined.drop("_bucket", "_value", "_nth", "_before", "_opens", "_seen", "_edge", "_carry")


def with_lookback(df: DataFrame, ts: Column, span_sec: float, bucket_sec: float) -> DataFrame:
    """Cut time into buckets and lend each bucket the last ``span_sec`` of the one before.

    Adds ``_bucket`` and ``_lent``; a window of at most ``span_sec`` back is then complete
    inside one bucket.  Lent rows are only context and are filtered afterwards.
    """
    us, width, span = F.unix_micros(ts), int(bucket_sec * 1_000_000), int(span_sec * 1_000_000)
    if span > width:
        raise ValueError("the bucket must be at least as wide as the look-back")
    home = F.floor(us / F.lit(width))
    reach = F.floor((us + F.lit(span)) / F.lit(width))
    spread = F.when(reach > home, F.array(
        F.struct(home.alias("b"), F.lit(False).alias("lent")),
        F.struct(reach.alias("b"), F.lit(True).alias("lent")))).otherwise(
        F.array(F.struct(home.alias("b"), F.lit(False).alias("lent"))))
    return df.withColumn("_x", F.explode(spread)).withColumn("_bucket", F.col("_x.b")) \
        .withColumn("_lent", F.col("_x.lent")).drop("_x")


def trailing_count(df: DataFrame, keys: list[str], ts: Column, arrival: Column, span_sec: float,
                   out: str, *, bucket_sec: float = 600.0, closed: bool = True) -> DataFrame:
    """Rows of a key in the last ``span_sec`` up to this row in arrival order.

    ``closed`` counts a row exactly ``span_sec`` old; rows at the same instant that arrive
    later are not counted.
    """
    us = F.unix_micros(ts)
    span = int(span_sec * 1_000_000) - (0 if closed else 1)
    cut = with_lookback(df, ts, span_sec, bucket_sec)
    group = [*keys, "_bucket"]
    within = Window.partitionBy(*group).orderBy(us).rangeBetween(-span, HERE)
    peers = Window.partitionBy(*group, us)
    nth = Window.partitionBy(*group, us).orderBy(arrival)
    n = F.count("*").over(within) - (F.count("*").over(peers) - F.row_number().over(nth))
    return cut.withColumn(out, n).where(~F.col("_lent")).drop("_bucket", "_lent")

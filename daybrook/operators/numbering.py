"""Running sums and numbers over a whole table: a range-partitioned sort, one total a range, prefix sums of the totals."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybrook.session import materialize


def before(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add, for each name in ``sums``, the sum of its expression over all rows before this one; null counts as 0.

    The table is written before it is sorted, so that finding the ranges does not compute it twice.
    Rows are sorted into ranges of ``order`` and written; a range is one task, and what goes from one
    range to the next is one row of totals, so no key and no single task sees the whole table.
    ``order`` should tell nearly all rows apart: rows that are equal in it share a range.
    """
    spark, names = df.sparkSession, list(sums)
    placed = df.withColumns({f"_add_{name}": value.cast("bigint") for name, value in sums.items()})
    placed = materialize(placed, "unsorted").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "ranges")
    totals = placed.groupBy("_part").agg(*(F.coalesce(F.sum(f"_add_{name}"), F.lit(0)).alias(name) for name in names)).orderBy("_part").collect()
    carried = zip(*(accumulate([row[name] for row in totals], initial=0) for name in names), strict=True)
    table = [(row["_part"], *carry) for row, carry in zip(totals, carried, strict=False)]
    carry = spark.createDataFrame(table, ", ".join(["_part int", *(f"_carry_{name} bigint" for name in names)]))
    inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    own = {name: F.coalesce(F.sum(f"_add_{name}").over(inside), F.lit(0)) + F.col(f"_carry_{name}") for name in names}
    summed = placed.join(F.broadcast(carry), "_part").withColumns(own)
    return summed.drop("_part", "_place", *(f"_{kind}_{name}" for kind in ("add", "carry") for name in names))


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Row number over the whole table, from 1."""
    return before(df, order, {out: F.lit(1)}).withColumn(out, F.col(out) + 1)


def within(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """Row number inside each key, from 1: the number in the whole table less that of the key's first row.

    Null is a key like any other.  A key of any size spreads over as many ranges as it fills.
    """
    rows = materialize(before(df, [*map(F.col, keys), *order], {"_in_all": F.lit(1)}), "numbered")
    same = None
    first = rows.groupBy(*keys).agg(F.min("_in_all").alias("_first_in_all")).select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_first_in_all")
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        same = test if same is None else same & test
    return rows.join(first, same).withColumn(out, F.col("_in_all") - F.col("_first_in_all") + 1).drop("_in_all", "_first_in_all", *(f"_k_{k}" for k in keys))

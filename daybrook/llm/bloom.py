"""Fixed-size bit filters over hashes as tables of 4 KB bitmap pages, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter.  Its pages take at most ``BITS / 8`` bytes (8 MB) whatever the data hold, so they may be broadcast.
BITS = 1 << 26


def cell(value: Column, bits: int = BITS) -> Column:
    """The bit of a hash; bitmap functions count positions from one."""
    return F.pmod(F.xxhash64(value), F.lit(bits)) + F.lit(1)


def pages(cells: DataFrame, column: str = "cell") -> DataFrame:
    """``(page, bits)`` with a bit set for every cell of the table; at most ``BITS / 32768`` rows."""
    return cells.groupBy(F.bitmap_bucket_number(column).alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(column)).alias("bits"))


def repeated_pages(rows: DataFrame, column: str = "cell") -> DataFrame:
    """Pages of the cells that two rows or more fall into.  Only cells are shuffled, summed before they leave a task."""
    return pages(rows.groupBy(column).agg(F.count("*").alias("hits")).where("hits > 1"), column)


def flagged(rows: DataFrame, filter_pages: DataFrame, column: str = "cell", name: str = "maybe") -> DataFrame:
    """``rows`` with a boolean that is true where the filter has the row's bit; no row is shuffled."""
    page, bits = f"{name}_page", f"{name}_bits"
    looked = rows.join(F.broadcast(filter_pages.select(F.col("page").alias(page), F.col("bits").alias(bits))),
                       F.bitmap_bucket_number(column) == F.col(page), "left")
    at = F.bitmap_bit_position(column)
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1
    return looked.withColumn(name, F.coalesce(hit, F.lit(False))).drop(page, bits)


def without(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is in ``ids``; rows that a filter over ``ids`` rules out pass without a shuffle.

    A row without an id stays.  Columns of ``docs`` may have any name but ``_daybrook_*``.
    """
    gone = ids.select(F.col(column).alias("_daybrook_gone")).where("_daybrook_gone is not null").distinct()
    marks = pages(gone.select(cell(F.col("_daybrook_gone")).alias("_daybrook_cell")), "_daybrook_cell")
    tested = flagged(docs.withColumn("_daybrook_cell", cell(F.col(column))), marks, "_daybrook_cell", "_daybrook_maybe")
    tested = tested.drop("_daybrook_cell")
    suspects = tested.where("_daybrook_maybe").drop("_daybrook_maybe")
    return tested.where("not _daybrook_maybe").drop("_daybrook_maybe").unionByName(
        suspects.join(gone, F.col(column) == F.col("_daybrook_gone"), "left_anti"))

"""Gapless numbers within groups of any size, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 4096


def gapless(df: DataFrame, keys: list[str], order: list[str], name: str, rows: int) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... in the column `name`.

    A hash deals a group's rows into blocks; a block is sorted by itself and its
    numbers begin where the counts of the blocks before it end.  So a group that
    holds most of the table is still sorted in many tasks.  `rows` is the size of
    the table.  Rows that agree in `order` are alike and may swap numbers.
    """
    blocks = max(1, -(-rows // ROWS_PER_BLOCK))
    salt = F.monotonically_increasing_id() if not order else F.xxhash64(*order)
    dealt = df.withColumn("_block", F.pmod(salt, F.lit(blocks)).cast("int"))
    spots = [*keys, "_block"]
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        dealt.groupBy(*spots)
        .agg(F.count("*").alias("_n"))
        .select(*spots, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    )
    inside = Window.partitionBy(*spots).orderBy(*(order or spots))
    return (
        dealt.withColumn("_place", F.row_number().over(inside) - 1)
        .join(first, spots)
        .withColumn(name, (F.col("_first") + F.col("_place")).cast("long"))
        .drop("_block", "_place", "_first")
    )

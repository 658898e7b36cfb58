"""Exact quantiles of groups of any size.

The built-in exact percentile holds every distinct value of a group in one
task.  `group_quantiles` keeps it for values that are first counted into a
bounded set; `large_quantiles` selects the wanted ranks digit by digit of the
values' 64-bit images, so that only counts of digits are ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featherline.session import keep

DIGIT_BITS = 16
#: Values that share their first digits with a wanted rank are dealt into so many parts for a join.
PARTS = 16


def group_quantiles(df: DataFrame, by: list[str], x: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles for a value with few distinct levels, such as day counts."""
    counted = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*by).agg(
        *[F.percentile(x, F.lit(p), F.col("_n")).alias(name) for name, p in probs.items()]
    )


def _image(x: Column) -> Column:
    """A long in the order of the doubles: not-a-number is the greatest, both zeros are alike."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def _holding(bins: DataFrame, group: list[str], targets: Column) -> DataFrame:
    """The bins that hold a wanted rank, with these ranks, counted from the bin's first value, as `_targets`."""
    along = Window.partitionBy(*group).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("_end") - F.col("_c")
    here = F.filter(targets, lambda t: (t["rank"] >= start) & (t["rank"] < F.col("_end")))
    moved = F.transform(here, lambda t: F.struct(t["name"].alias("name"), t["upper"].alias("upper"), t["part"].alias("part"), (t["rank"] - start).alias("rank")))
    return bins.withColumn("_end", F.sum("_c").over(along)).withColumn("_targets", moved).where(F.size("_targets") > 0)


def large_quantiles(df: DataFrame, by: list[str], x: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles of any number of distinct values, one way at every size.

    Radix selection: equal values are counted; the counts of each group's first digits say
    which digit a rank lies in, the counts of the next digits among the values with that
    digit say the next, and so on.  Infinite values are values; nulls are left out, and
    not-a-number is the greatest.  Between equal values nothing is interpolated.
    """
    value = F.col(x).cast("double")
    known = df.where(F.col(x).isNotNull()).select(*by, value.alias("_x"))
    image = _image(F.col("_x"))
    levels = keep(known.groupBy(*by, image.alias("_k")).agg(F.count(F.lit(1)).alias("_c"), F.max("_x").alias("_x")))

    def prefix(digits: int) -> Column:
        return F.shiftright("_k", 64 - DIGIT_BITS * digits) if digits * DIGIT_BITS < 64 else F.col("_k")

    bins = levels.groupBy(*by, prefix(1).alias("_prefix")).agg(F.sum("_c").alias("_c"), F.max("_x").alias("_x"))
    bins = bins.withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    wanted = []
    for name, p in probs.items():
        rank = F.lit(float(p)) * (F.col("_n") - 1)
        for upper, whole in ((False, F.floor(rank)), (True, F.ceil(rank))):
            wanted.append(F.struct(F.lit(name).alias("name"), F.lit(upper).alias("upper"), (rank - F.floor(rank)).alias("part"), whole.cast("long").alias("rank")))
    heads = _holding(bins, by, F.array(*wanted))
    for digits in range(2, 64 // DIGIT_BITS + 1):
        heads = heads.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_prefix").alias("_head"), "_targets", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"))
        match = (prefix(digits - 1) == F.col("_head")) & (F.pmod(F.xxhash64("_k"), F.lit(PARTS)) == F.col("_part"))
        for c in by:
            match = match & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
        near = levels.join(heads, match).groupBy(*by, "_head", "_targets", prefix(digits).alias("_prefix")).agg(F.sum("_c").alias("_c"), F.max("_x").alias("_x"))
        heads = _holding(near, [*by, "_head"], F.col("_targets"))
    found = heads.select(*by, "_x", F.explode("_targets").alias("_t"))

    def quantile(name: str) -> Column:
        def side(upper: bool) -> Column:
            return F.max(F.when((F.col("_t.name") == name) & (F.col("_t.upper") == upper), F.col("_x")))

        a, b, part = side(False), side(True), F.max(F.when(F.col("_t.name") == name, F.col("_t.part")))
        endless = F.lit(float("inf"))
        mixed = F.when((F.abs(a) == endless) | (F.abs(b) == endless), a * (1 - part) + b * part).otherwise(a + (b - a) * part)
        return F.when((part == 0) | (a == b), a).otherwise(mixed)

    return found.groupBy(*by).agg(*[quantile(name).alias(name) for name in probs])

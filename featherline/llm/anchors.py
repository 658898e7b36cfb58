"""Anchors: positions chosen by content, so that equal passages hold equal anchors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherline.llm.arrays import mix, powers
from featherline.llm.tables import keep

#: A key is hot if it holds more than this part of all rows, so there are fewer hot keys than this number.
HOT_PARTS = 2000


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any run of values."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(len(values) + 1)[0][:-1], out=sums[1:])
    return sums


def run_hashes(sums: np.ndarray, begins: np.ndarray, ends: np.ndarray, extra: np.ndarray | int = 0) -> np.ndarray:
    """Hashes of runs of values, and of what `extra` tells apart."""
    down = powers(len(sums))[1]
    return mix((sums[ends] - sums[begins]) * down[begins] + np.asarray(extra).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def least_positions(hashes: np.ndarray, valid: np.ndarray, count: int, stride: int = 1) -> np.ndarray:
    """Positions that hold the least of the hashes at i, i + stride, ..., `count` of them, for some valid i.

    Of equal hashes the first counts.
    """
    reach = (count - 1) * stride
    if len(hashes) <= reach or not len(valid):
        return np.zeros(0, np.int64)
    place = np.uint64((1 << int(len(hashes)).bit_length()) - 1)
    least = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
    covered = 1
    while 2 * covered <= count:
        least = np.minimum(least[: len(least) - covered * stride], least[covered * stride :])
        covered *= 2
    if covered < count:
        rest = (count - covered) * stride
        least = np.minimum(least[: len(least) - rest], least[rest:])
    chosen = np.zeros(len(hashes), bool)
    chosen[(least[valid] & place).astype(np.int64)] = True
    return np.flatnonzero(chosen)


def inside(at: np.ndarray, need: int, least: int = 0) -> np.ndarray:
    """Positions from which `need` elements of the same row follow, in rows of `least` elements or more."""
    length = np.diff(at)
    count = np.where(length >= least, np.maximum(length - need + 1, 0), 0)
    return np.arange(int(count.sum())) + np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)


def context_groups(rows: DataFrame, place: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split occurrences of anchors into those with an equal context at an earlier place, and first ones.

    rows: anchor, context, left, right (hashes of the nearer half of the context on
    either side), the columns of `place`, and others.  The first ones are returned
    only if another first one of the same anchor agrees with it on the left or on
    the right; a shared passage that holds the anchor reaches that far on one side.

    The first places of hot keys, fewer than HOT_PARTS by counting, are broadcast, so that their rows
    stay where they are; all other keys are joined, and none of them holds more than a
    small part of the rows.
    """
    spot, key = F.struct(*place), ["anchor", "context"]
    limit = rows.count() // HOT_PARTS
    found = keep(rows.groupBy(*key).agg(F.min(spot).alias("_first"), F.count(F.lit(1)).alias("_n")))
    hot, first = F.broadcast(found.where(F.col("_n") > limit + 1).drop("_n")), found.where(F.col("_n") <= limit + 1).drop("_n")
    rows = rows.join(hot, key).unionByName(rows.join(first.hint("merge"), key))
    later = rows.where(spot > F.col("_first"))
    firsts = rows.where(spot <= F.col("_first")).drop("_first")
    sides = firsts.select("*", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("half")), F.struct(F.lit(1).alias("side"), F.col("right").alias("half")))).alias("s"))
    sides = sides.select("*", "s.side", "s.half").drop("s")
    shared = sides.groupBy("anchor", "side", "half").agg(F.min("context").alias("c0"), F.max("context").alias("c1")).where("c0 <> c1")
    alive = sides.join(shared.select("anchor", "side", "half"), ["anchor", "side", "half"]).select(*firsts.columns).distinct()
    return later, alive

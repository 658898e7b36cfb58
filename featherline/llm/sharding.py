"""Shards by a hierarchical weighted hash tree.

A key descends from the root to a region, a rack and a shard.  At each node every
child draws an exponential variate from the hash of the key and the child's path,
divided by the child's weight; the least draw wins.  So a child is chosen with
its share of the weight, and when weights change, keys move only into or out of
the subtrees whose weights change.  A new shard opens a region of its own, so
that it takes keys only into itself.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featherline.llm.ranks import gapless


class Leaf(NamedTuple):
    """A shard, where it stands, and its weight."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(shards: int, racks: int = 3, per_rack: int = 4) -> list[Leaf]:
    """Shards of weight one; a region holds `racks` racks of `per_rack` shards."""
    return [Leaf(s // (racks * per_rack), s // per_rack % racks, s) for s in range(shards)]


def grow(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, alone in a new region."""
    return [*tree, Leaf(max(x.region for x in tree) + 1, 0, max(x.shard for x in tree) + 1, weight)]


def _pick(key: Column, children: dict[int, float], path: str) -> Column:
    """The number of the child with the least weighted draw; equal draws: the smaller number."""
    if len(children) == 1:
        return F.lit(next(iter(children)))

    def draw(child: int, weight: float) -> Column:
        unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{path}/{child}")), 11) + 0.5) / float(1 << 53)
        return F.struct((-F.ln(unit) / float(weight)).alias("draw"), F.lit(child).alias("child"))

    return F.array_min(F.array(*(draw(*x) for x in sorted(children.items())))).getField("child")


def shard_of(df: DataFrame, key: str, tree: Sequence[Leaf], name: str) -> DataFrame:
    """Add the shard of each row's key.  A null key is a key like any other.

    Shards of weight zero or less get no rows; one shard at least needs weight.
    """
    regions: dict[int, float] = defaultdict(float)
    racks: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    shards: dict[tuple[int, int], dict[int, float]] = defaultdict(dict)
    for x in tree:
        if x.weight > 0:
            regions[x.region] += x.weight
            racks[x.region][x.rack] += x.weight
            shards[x.region, x.rack][x.shard] = x.weight
    if not regions:
        raise ValueError("no shard has weight")
    region, rack = f"_{name}_region", f"_{name}_rack"
    by_rack = F.coalesce(*(F.when(F.col(region) == r, _pick(F.col(key), c, f"{r}")) for r, c in racks.items()))
    by_shard = F.coalesce(
        *(
            F.when((F.col(region) == r) & (F.col(rack) == k), _pick(F.col(key), c, f"{r}/{k}"))
            for (r, k), c in shards.items()
        )
    )
    return (
        df.withColumn(region, _pick(F.col(key), regions, "root"))
        .withColumn(rack, by_rack)
        .withColumn(name, by_shard.cast("int"))
        .drop(region, rack)
    )


def place(docs: DataFrame, tree: Sequence[Leaf]) -> DataFrame:
    """Shard, slot and the shard after growth of every document.

    docs: doc_id, text; further columns are not read.  Null texts have no bytes.
    Repeated rows keep their number; copies with one doc_id share a shard and
    have slots of their own.  An empty table gives no rows.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = shard_of(shard_of(rows, "doc_id", tree, "shard"), "doc_id", grow(tree), "grown_shard")
    order = ["doc_id", "text_crc32", "size"]
    return gapless(rows, ["shard"], order, "slot", docs.count()).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )

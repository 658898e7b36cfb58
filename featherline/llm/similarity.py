"""Near duplicates of embeddings by int8 tile products with error bounds.

A vector x of length one is stored as s * q + e with q of int8 and the length of
e known.  For two vectors, x . y differs from s_x s_y (q_x . q_y) by at most
e_x + e_y + e_x e_y, so the int8 product rules out most pairs for certain; only
the others are computed again in double precision.  Products of int8 numbers are
exact in float32 while they stay below 2**24, so tiles use float32 matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherline.llm.components import components
from featherline.llm.tables import keep

TILE_ROWS = 4096
STRIP_ROWS = 1024
TILE = "tile int, ids binary, nth binary, copies binary, q binary, scale binary, error binary, unit binary, dims int"
FOUND = "vec_id long, nth long, n_links long, root long, root_nth long"


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and an upper bound of the length of each vector's error."""
    top = np.abs(unit).max(axis=1, initial=0.0)
    scale = np.where(top > 0, top, 1.0) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return codes, scale, error * (1 + 1e-9) + 1e-12


def exact(a: np.ndarray) -> np.ndarray:
    """Vectors scaled to length one in double precision."""
    a = a.astype(np.float64)
    a = a / np.abs(a).max(axis=1, keepdims=True)
    return a / np.sqrt(np.einsum("ij,ij->i", a, a))[:, None]


def close_pairs(a: dict, b: dict, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs of two tiles with cosine at or above the threshold."""
    step = (1 << 24) // 127**2  # so many products have an exact float32 sum
    right = b["q"].astype(np.float32).T
    for first in range(0, len(a["q"]), STRIP_ROWS):
        rows = slice(first, first + STRIP_ROWS)
        left = a["q"][rows].astype(np.float32)
        product = left[:, :step] @ right[:step]
        for k in range(step, left.shape[1], step):
            product = product + (left[:, k : k + step] @ right[k : k + step]).astype(np.float64)
        # s_x s_y p + e_x + e_y + e_x e_y >= t, as a bound on p for each pair
        error, other = a["error"][rows, None], b["error"][None, :]
        product *= (a["scale"][rows, None] * b["scale"][None, :]).astype(np.float32)
        slack = (error + other + error * other).astype(np.float32)
        i, j = np.nonzero(product + slack >= np.float32(threshold - 1e-5))
        i += first
        if same:
            i, j = i[j > i], j[j > i]
        for part in range(0, len(i), 1 << 16):
            x, y = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
            good = np.einsum("ij,ij->i", a["unit"][x], b["unit"][y]) >= threshold
            yield x[good], y[good]


def local_roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least row number that each of n rows reaches over the pairs."""
    root = np.arange(n)
    while True:
        before = root.copy()
        for x, y in pairs:
            least = np.minimum(root[x], root[y])
            np.minimum.at(root, x, least)
            np.minimum.at(root, y, least)
        root = root[root]
        if (root == before).all():
            return root


def tiles(vectors: DataFrame, count: int) -> DataFrame:
    """Pack distinct vectors (vec_id, nth, copies, embedding) into `count` rows for each number of dimensions.

    vec_id and nth together name a vector.
    """

    def pack(table: pa.Table) -> pa.Table:
        column = table.column("embedding").combine_chunks()
        at, flat = np.asarray(column.offsets), np.asarray(column.values)
        data = flat[at[0] : at[-1]].reshape(len(table), -1)
        unit = exact(data)
        codes, scale, error = quantise(unit)
        order = np.lexsort((table.column("nth").to_numpy(), table.column("vec_id").to_numpy()))
        row = {
            "tile": pa.array([table.column("tile")[0].as_py()], pa.int32()),
            "ids": table.column("vec_id").to_numpy()[order].astype(np.int64),
            "nth": table.column("nth").to_numpy()[order].astype(np.int64),
            "copies": table.column("copies").to_numpy()[order].astype(np.int64),
            "q": codes[order],
            "scale": scale[order],
            "error": error[order],
            "unit": data[order],
            "dims": pa.array([data.shape[1]], pa.int32()),
        }
        return pa.table({k: pa.array([v.tobytes()], pa.binary()) if isinstance(v, np.ndarray) else v for k, v in row.items()})

    dealt = vectors.withColumn("tile", F.pmod(F.xxhash64("vec_id", "nth"), F.lit(count)).cast("int"))
    return dealt.select("tile", "vec_id", "nth", "copies", "embedding").groupBy("tile", F.size("embedding").alias("dims")).applyInArrow(pack, TILE)


def _unpack(row: dict) -> dict:
    ids = np.frombuffer(row["ids"], np.int64)
    kind = np.float64 if len(row["unit"]) == 8 * len(ids) * row["dims"] else np.float32
    return {
        "ids": ids,
        "nth": np.frombuffer(row["nth"], np.int64),
        "copies": np.frombuffer(row["copies"], np.int64),
        "q": np.frombuffer(row["q"], np.int8).reshape(len(ids), -1),
        "scale": np.frombuffer(row["scale"]),
        "error": np.frombuffer(row["error"]),
        "unit": exact(np.frombuffer(row["unit"], kind).reshape(len(ids), -1)),
    }


def tile_links(packed: DataFrame, count: int, threshold: float) -> DataFrame:
    """Compare every two tiles once: for each vector its links there and the least vector it reaches there."""
    sides = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    sides = sides.select("*", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))

    def compare(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["tile"])
        if rows[0]["tile"] != rows[0]["low"] or rows[-1]["tile"] != rows[0]["high"]:  # the other tile has no vectors
            return pa.table({k: pa.array([], pa.int64()) for k in ("vec_id", "nth", "n_links", "root", "root_nth")})
        a, b = _unpack(rows[0]), _unpack(rows[-1])
        same = rows[0]["low"] == rows[0]["high"]
        n = len(a["ids"])
        shift = 0 if same else n
        ids = a["ids"] if same else np.concatenate([a["ids"], b["ids"]])
        nth = a["nth"] if same else np.concatenate([a["nth"], b["nth"]])
        copies = a["copies"] if same else np.concatenate([a["copies"], b["copies"]])
        links, pairs = np.zeros(len(ids), np.int64), []
        for x, y in close_pairs(a, b, threshold, same):
            y = y + shift
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            pairs.append((x, y))
        # Rows stand in the order of their numbers within a tile only; roots are least by number.
        order = np.lexsort((nth, ids))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        root = order[local_roots(len(ids), [(place[x], place[y]) for x, y in pairs])][place]
        found = links > 0
        root = root[found]
        return pa.table({"vec_id": ids[found], "nth": nth[found], "n_links": links[found], "root": ids[root], "root_nth": nth[root]})

    return sides.groupBy("dims", "low", "high").applyInArrow(compare, FOUND)


def near_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Links and component of each vector by cosine.

    vectors: vec_id, embedding (numbers); further columns are not read.  Vectors
    that are null, empty or zero, or hold a null or non-finite component, and rows
    with a null vec_id, link with nothing.  Vectors of different lengths do not link.
    Equal vectors are compared as one row with its number of copies, so a vector that
    is very common makes no pairs.  Repeated rows of one vec_id count as vectors each: equal
    ones link, and different ones have links and components of their own.  Numbers of
    double precision are compared as such, others as floats.
    An empty table gives no rows.

    Returns vec_id, n_links, component_id, kept.
    """
    wide = vectors.schema["embedding"].dataType.elementType.typeName() not in ("float", "byte", "short")
    kind = "double" if wide else "float"
    numbers = F.col("embedding").cast(f"array<{kind}>")
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("vec_id").isNotNull() & numbers.isNotNull() & finite & F.exists(numbers, lambda x: x != 0)
    # 0.0 and -0.0 are equal numbers
    rows = vectors.select("vec_id", F.when(usable, F.transform(numbers, lambda x: x + F.lit(0.0).cast(kind))).alias("embedding"))
    good = rows.where("embedding is not null")
    distinct = good.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    distinct = keep(distinct.withColumn("nth", F.monotonically_increasing_id()))  # different vectors may share a vec_id
    count = max(1, -(-distinct.count() // TILE_ROWS))
    found = keep(tile_links(tiles(distinct, count), count, threshold))
    node = F.struct("vec_id", "nth")
    reach = components(found.select(node.alias("a"), F.struct(F.col("root").alias("vec_id"), F.col("root_nth").alias("nth")).alias("b")))
    links = found.groupBy("vec_id", "nth").agg(F.sum("n_links").alias("others"))
    reach = reach.select("node.vec_id", "node.nth", F.col("component.vec_id").alias("component"))
    classes = (
        distinct.join(links, ["vec_id", "nth"], "left")
        .join(reach, ["vec_id", "nth"], "left")
        .select(
            F.col("embedding"),
            (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        )
    )
    return (
        rows.join(classes, "embedding", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )

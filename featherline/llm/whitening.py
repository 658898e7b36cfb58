"""Whitening of embeddings.

Vectors become integers, whose sums are exact.  The scatter of the centred vectors is
summed by Spark; a Cholesky factorisation with diagonal pivots gives its triangular factor,
and one-sided Jacobi rotations make the columns of that factor orthogonal.  Their squared
norms are the eigenvalues of the scatter, the normalised columns its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
#: Larger magnitudes count as this, so that an entry fits into a double exactly.
LARGEST = float(1 << 52)
#: Entries of a block of rows that is worked on at a time.
BLOCK_ENTRIES = 1 << 19
SWEEPS = 60
#: The first number that the exact column does not hold; there it is null.
MOST = 10**38
WHOLE = "decimal(38,0)"
RESULT = "vec_id long, component int, n long, deviation_exact decimal(38,0), whitened double, explained double, identity_error double"
_exact = Context(prec=60).create_decimal


def integers(column: pa.Array) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """The valid vectors of a list column by length: (length, rows, matrix of integers)."""
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become not-a-number
    begins = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
    valid = (size >= 0) & (bad[begins + np.maximum(size, 0)] == bad[begins])
    found = []
    for length in np.unique(size[valid]).tolist():
        rows = np.flatnonzero(valid & (size == length))
        step = max(1, BLOCK_ENTRIES // max(1, length))
        for first in range(0, len(rows), step):
            some = rows[first : first + step]
            values = flat[begins[some][:, None] + np.arange(length)]
            scaled = np.clip(np.floor(SCALE * values), -LARGEST, LARGEST)
            found.append((length, some, scaled.astype(np.int64) + SHIFT))
    return size, found


def _fits(largest: int, times: int) -> bool:
    return largest * times < 1 << 62


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of the columns, whatever their size."""
    if not x.size or _fits(int(np.abs(x).max()), len(x)):
        return x.sum(axis=0).tolist()
    return x.astype(object).sum(axis=0).tolist()


class Centre:
    """n and the exact sums of all vectors that are fitted."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n*x-S, exact: 64-bit integers, or Python's where those are too small."""
        largest = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums), default=0))
        if _fits(largest, 2):
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def squares(self, d: np.ndarray) -> list[int]:
        """Sum of squares of each row of n*x-S, exact."""
        largest = max(abs(int(d.max(initial=0))), abs(int(d.min(initial=0))))
        if d.dtype == object or not _fits(largest * largest, max(1, d.shape[1])):
            d = d.astype(object)
        return (d * d).sum(axis=1).tolist()

    def centred(self, d: np.ndarray) -> np.ndarray:
        """x-S/n in doubles."""
        return (d / self.n).astype(np.float64)


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """L with scatter = L L^T, one column for each pivot above rounding; rows stay in their order.

    Rows in order of their pivots make L triangular.
    """
    rest, columns = scatter.copy(), []
    least = len(scatter) * np.finfo(float).eps * max(np.diag(scatter).max(initial=0.0), 0.0)
    free = np.ones(len(scatter), bool)
    while free.any():
        pivot = int(np.argmax(np.where(free, np.diag(rest), -np.inf)))
        if not rest[pivot, pivot] > least:
            break
        column = np.where(free, rest[:, pivot], 0.0) / np.sqrt(rest[pivot, pivot])
        rest -= np.outer(column, column)
        free[pivot] = False
        columns.append(column)
    return np.array(columns).reshape(-1, len(scatter)).T


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms, falling, and the normalised columns, after rotating all pairs of columns to be orthogonal.

    The pairs of a sweep are taken in rounds of disjoint pairs, as in a tournament.
    """
    u = factor.copy()
    players = list(range(u.shape[1])) + ([-1] if u.shape[1] % 2 else [])
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(players) - 1):
            half = len(players) // 2
            pairs = [(a, b) for a, b in zip(players[:half], reversed(players[half:])) if a >= 0 and b >= 0]
            if pairs:
                i, j = np.array(pairs).T
                a, b = u[:, i], u[:, j]
                aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
                off = np.abs(ab) / np.sqrt(aa * bb)
                worst = max(worst, float(off.max()))
                zeta = (bb - aa) / (2 * np.where(ab == 0, 1, ab))
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                t = np.where(off > 1e-17, t, 0.0)
                c = 1 / np.hypot(1, t)
                u[:, i], u[:, j] = c * a - c * t * b, c * t * a + c * b
            players[1:] = players[-1:] + players[1:-1]
        if worst < 1e-15 * max(1, len(u)):
            break
    norms = (u * u).sum(axis=0)
    order = np.argsort(-norms, kind="stable")
    return norms[order], u[:, order] / np.sqrt(norms[order])


def fit_centre(vectors: DataFrame) -> tuple[int, Centre]:
    """Length, and n and sums, of the vectors of the most frequent length (of those alike, the greatest)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for length, _, x in integers(batch.column("embedding"))[1]:
                n, sums = totals.get(length, (0, [0] * length))
                totals[length] = n + len(x), [a + b for a, b in zip(sums, exact_sums(x))]
        for length, (n, sums) in totals.items():
            places, values = [-1, *range(length)], [_exact(v) for v in (n, *sums)]
            yield pa.RecordBatch.from_arrays([pa.array([length] * (length + 1)), pa.array(places), pa.array(values, pa.decimal128(38, 0))], ["length", "place", "total"])

    parts = vectors.select("embedding").mapInArrow(run, f"length long, place long, total {WHOLE}")
    rows = parts.groupBy("length", "place").agg(F.sum("total").alias("total"))
    counts = {r.length: int(r.total) for r in rows.where("place = -1").collect()}
    if not counts:
        return 0, Centre(0, [])
    length = max(counts, key=lambda k: (counts[k], k))
    sums = {r.place: int(r.total) for r in rows.where((F.col("length") == length) & (F.col("place") >= 0)).collect()}
    return length, Centre(counts[length], [sums[k] for k in range(length)])


def _summed(vectors: DataFrame, length: int, width: int, product) -> np.ndarray:
    """The sum over all fitted vectors of a symmetric matrix; product: integers to the matrix of some rows.

    Each task sums its rows; Spark sums the tasks' matrices entry by entry.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for found, _, x in integers(batch.column("embedding"))[1]:
                if found == length:
                    total += product(x)
        for k in range(width):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.ListArray.from_arrays(pa.array([0, width - k], pa.int32()), pa.array(total[k, k:]))], ["i", "entries"])

    parts = vectors.select("embedding").mapInArrow(run, "i int, entries array<double>")
    entries = parts.select("i", F.posexplode("entries").alias("j", "value")).groupBy("i", "j").agg(F.sum("value").alias("value"))
    out = np.zeros((width, width))
    for r in entries.collect():
        out[r.i, r.i + r.j] = out[r.i + r.j, r.i] = r.value
    return out


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """Each vector on the leading principal components, scaled to unit variance.

    vectors: vec_id, embedding (floats or doubles); further columns are not read.  Rows
    whose embedding is null or holds null or non-finite entries are dropped, and those of
    another length than most.  Repeated rows count, and are returned, as often as they
    stand.  Returns vec_id, component, n, deviation_exact, whitened, explained and
    identity_error; components whose variance is zero to rounding have no rows, so equal
    vectors alone, and an empty table, give none.
    """
    spark = vectors.sparkSession
    column = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    length, centre = fit_centre(column)

    def scatter(x: np.ndarray) -> np.ndarray:
        d = centre.centred(centre.deviations(x))
        return d.T @ d

    if not length:
        return spark.createDataFrame([], RESULT)
    covariance = _summed(column, length, length, scatter) / centre.n
    values, axes = one_sided_jacobi(pivoted_cholesky(covariance))
    count = min(components, len(values))
    trace = float(np.trace(covariance))
    explained = values[:count] / trace if count else values
    axes = axes[:, :count] / np.sqrt(values[:count])

    def project(x: np.ndarray) -> np.ndarray:
        return centre.centred(centre.deviations(x)) @ axes

    def square(x: np.ndarray) -> np.ndarray:
        w = project(x)
        return w.T @ w

    # Whitened vectors are centred, for the vectors were: their mean is zero to rounding.
    error = float(np.abs(_summed(column, length, count, square) / centre.n - np.eye(count)).max()) if count else 0.0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found, rows, x in integers(batch.column("embedding"))[1]:
                if found != length:
                    continue
                d = centre.deviations(x)
                exact = [_exact(v) if v < MOST else None for v in centre.squares(d)]
                w = centre.centred(d) @ axes
                some = np.repeat(rows, count)
                many = len(some)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(some)),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(many, centre.n)),
                        pa.array(exact, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(rows)), count))),
                        pa.array(w.ravel()),
                        pa.array(np.tile(explained, len(rows))),
                        pa.array(np.full(many, error)),
                    ],
                    ["vec_id", "component", "n", "deviation_exact", "whitened", "explained", "identity_error"],
                )

    return column.mapInArrow(run, RESULT)

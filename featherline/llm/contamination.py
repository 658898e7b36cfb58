"""Benchmark items inside documents, by size-partitioned MinHash containment search.

Items are partitioned by their number of shingles into classes that double.  For each
class a document is cut into windows of twice the class's size, half overlapping, so
that an item meets windows of its own size however long the document is, and the
share of a window's shingles that it makes up has a lower bound.  A window is a
candidate for an item if one of their MinHash values agrees.  Items of few different
shingles, which are too small a share of any window, and repetitive items are looked
up by shingle instead, without loss: of n shingles k must be found, so one of any
n - k + 1 must.  Candidates are verified by the exact share of the item's shingles in
the whole document.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherline.llm.arrays import chunks, seeds
from featherline.llm.signatures import batch_shingles, minhash

WIDTH, THRESHOLD = 5, 0.8
PERMUTATIONS, SMALLEST = 48, 16
SEED = 11
#: An index holds so many items and bytes of items at most; more items are searched block after block.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 8 << 20
FOUND = "doc_id long, item_id long, n_shared long, n_shingles long, containment double"


def string_shingles(text: str, width: int) -> set[tuple[str, ...]]:
    words = [w.decode() for w in text.encode().split()]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


class Index:
    """MinHash values of a block of items by class, and their exact shingles."""

    def __init__(self, items: list[tuple[int, str]], width: int, threshold: float) -> None:
        self.ids = [i for i, _ in items]
        self.shingles = [string_shingles(t, width) for _, t in items]
        hashes, at = batch_shingles(pa.array([t for _, t in items], pa.string()), width)
        sizes = np.diff(at)
        values = np.zeros((PERMUTATIONS, len(items)), np.uint64)
        values[:, sizes > 0] = minhash(hashes, at, PERMUTATIONS, SEED)
        different = np.array([len(s) for s in self.shingles], np.int64)
        looked_up = (different <= SMALLEST) | (2 * different < sizes)
        keys, key_of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(looked_up & (sizes > 0)).tolist():
            mine = np.unique(hashes[at[i] : at[i + 1]])
            need = int(np.ceil(threshold * len(mine) - 1e-9))
            keys.append(mine[: len(mine) - max(need, 1) + 1])
            key_of.append(np.full(len(keys[-1]), i))
        order = np.argsort(np.concatenate(keys), kind="stable")
        self.keys, self.key_of = np.concatenate(keys)[order], np.concatenate(key_of)[order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.keys >> np.uint64(48)).astype(np.int64)] = True
        self.classes: list[tuple[int, list]] = []
        size = SMALLEST
        left = np.flatnonzero(~looked_up)
        while len(left):
            mine = left[sizes[left] <= size]
            tables = []
            for row in values:
                order = mine[np.argsort(row[mine], kind="stable")]
                maybe = np.zeros(1 << 16, bool)
                maybe[(row[order] >> np.uint64(48)).astype(np.int64)] = True
                tables.append((maybe, row[order], order))
            self.classes.append((size, tables))
            left = left[sizes[left] > size]
            size *= 2

    def candidates(self, hashes: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
        """Pairs (row, item number) with a looked-up shingle, or with a window that shares a MinHash value."""
        lengths = np.diff(at)
        found: set[tuple[int, int]] = set()
        if len(self.keys):
            hit = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
            a, b = np.searchsorted(self.keys, hashes[hit], "left"), np.searchsorted(self.keys, hashes[hit], "right")
            whose = np.searchsorted(at, hit, "right") - 1
            for k in np.flatnonzero(b > a).tolist():
                found.update((int(whose[k]), int(i)) for i in self.key_of[a[k] : b[k]])
        if not self.classes:
            return found
        blocks = -(-lengths // SMALLEST)
        block_at = np.concatenate([[0], np.cumsum(blocks)])
        if not block_at[-1]:
            return found
        nth = np.arange(block_at[-1]) - np.repeat(block_at[:-1], blocks)
        starts = np.repeat(at[:-1], blocks) + nth * SMALLEST
        row = np.repeat(np.arange(len(lengths)), blocks)
        product = np.empty(len(hashes), np.uint64)
        for j, factor in enumerate(seeds(PERMUTATIONS, SEED)):
            np.multiply(hashes, factor, out=product)
            least, owner = np.minimum.reduceat(product, starts), row
            for _, tables in self.classes:
                # least: of blocks of the class's size; a window is a block and the next of its row
                maybe, values, items = tables[j]
                window = least.copy()
                same = owner[1:] == owner[:-1]
                np.minimum(window[:-1], least[1:], out=window[:-1], where=same)
                if len(values):
                    hit = np.flatnonzero(maybe[(window >> np.uint64(48)).astype(np.int64)])
                    a, b = np.searchsorted(values, window[hit], "left"), np.searchsorted(values, window[hit], "right")
                    for k in np.flatnonzero(b > a).tolist():
                        found.update((int(owner[hit[k]]), int(i)) for i in items[a[k] : b[k]])
                first = np.append(True, ~same)
                place = np.arange(len(owner)) - np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0))
                even = np.flatnonzero(place % 2 == 0)
                least, owner = window[even], owner[even]
        return found


def _search(texts: DataFrame, index: Index, width: int, threshold: float) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in chunks(batches):
            column = batch.column("text")
            wanted = defaultdict(list)
            for row, item in index.candidates(*batch_shingles(column, width)):
                wanted[row].append(item)
            rows = []
            for row, items in sorted(wanted.items()):
                mine = string_shingles(column[row].as_py(), width)
                for item in sorted(items):
                    theirs = index.shingles[item]
                    count = len(theirs & mine)
                    if count >= threshold * len(theirs) - 1e-9:
                        rows.append((batch.column("doc_id")[row].as_py(), index.ids[item], count, len(theirs), count / len(theirs)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "n_shared", "n_shingles", "containment"])

    return texts.mapInArrow(run, FOUND)


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document and an item of which it holds at least `threshold` of the shingles.

    docs: doc_id, text; items: item_id, text; further columns are not read.  Words are
    lower-cased and separated by white space; shingles have `width` words, and a text
    of fewer words is one shingle, so a shorter item is found only as a whole text.
    Null and empty texts, and null item_ids, match nothing.  Repeated items count once;
    a repeated document repeats its rows.  Items are the query set: they are searched in
    blocks of bounded size, each against all documents.

    Returns doc_id, item_id, n_shared, n_shingles (of the item), containment.
    """
    words = F.lower(F.coalesce("text", F.lit(""))).alias("text")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words)
    queries = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), words).distinct()
    size = queries.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-size.n // BLOCK_ITEMS), -(-(size.bytes or 0) // BLOCK_BYTES))
    out = None
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        found = _search(texts, Index([(r.item_id, r.text) for r in part.collect()], width, threshold), width, threshold)
        out = found if out is None else out.unionByName(found)
    return out

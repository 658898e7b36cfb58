"""Jaccard join of word shingles with a MinHash LSH forest and exact verification.

Each tree of the forest holds the signatures of all documents as a trie, kept as a table
sorted by tree and signature, in which the documents below a node are neighbours.  All
documents are matched at full depth; a document whose expected recall is still below the
target is matched one level shorter, and so on.  How short depends on the document: the
fewer its shingles, the fewer similarities at or above the threshold it can have, and the
least of them sets its recall at a level.  Candidates that hang together form a group.  Groups are
cut into blocks of bounded weight, every two blocks of a group meet in one task, and
the exact Jaccard of each pair there is counted with intersections of the sets of 64-bit
shingle hashes as matrix products.  Tasks return counts and roots, never pairs, so that a large group of near
copies gives as many rows as documents.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherline.llm.arrays import chunks, list_array, mix, text_bytes
from featherline.llm.components import components
from featherline.llm.signatures import batch_shingles, minhash
from featherline.llm.similarity import local_roots
from featherline.llm.tables import keep, with_texts

WIDTH, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 20, 6, 0.9999
#: Documents of more shingles may have any similarity from the threshold on.
SMALL_SET = 40
#: Shingles of a block, and columns of a matrix of the verification.
BLOCK_SHINGLES = 200_000
MATRIX_CELLS = 4_000_000
MAX_BLOCK_ROWS = 1024

SIGNATURE = "doc_id long, text_key binary, n_shingles int, shortest int, signature binary"
LINK = "level int, node binary, a long, b long"


def expected_recall(similarity: float, prefix: int, trees: int) -> float:
    return 1.0 - (1.0 - similarity**prefix) ** trees


def prefix_length(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix that finds a pair at the threshold with the recall asked for; at least one."""
    length = depth
    while length > 1 and expected_recall(threshold, length, trees) < recall:
        length -= 1
    return length


def least_similarity(size: int, threshold: float) -> float:
    """The least Jaccard similarity at or above the threshold that a set of `size` elements can have."""
    least = 1.0
    for common in range(math.ceil(threshold * size - 1e-9), size + 1):
        union = math.floor(common / threshold + 1e-9)
        if common > 0 and union >= size:
            least = min(least, common / union)
    return least


def shortest_prefixes(threshold: float, trees: int, depth: int, recall: float) -> np.ndarray:
    """For sets of 0 to SMALL_SET elements and, in the last place, more: the level at which shortening ends."""
    similarities = [least_similarity(n, threshold) for n in range(SMALL_SET + 1)] + [threshold]
    return np.array([prefix_length(s, trees, depth, recall) for s in similarities], np.int32)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))


def signed(docs: DataFrame, width: int, trees: int, depth: int, shortest: np.ndarray) -> DataFrame:
    """For each document a key of its lower-cased text, its number of shingles, its shortest prefix and its signature.

    A signature is the values of all trees, tree by tree, of four bytes each.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = batch.column(1)
            hashes, at = batch_shingles(texts, width)
            sizes = np.diff(at)
            values = mix(minhash(hashes, at, trees * depth)).astype(">u4").T.tobytes()
            ends = np.cumsum(sizes > 0) * (4 * trees * depth)
            paths = [values[b - 4 * trees * depth : b] if n else b"" for n, b in zip(sizes, ends)]
            levels = shortest[np.minimum(sizes, SMALL_SET + 1)]
            for i in np.flatnonzero(sizes <= SMALL_SET):
                levels[i] = shortest[len(np.unique(hashes[at[i] : at[i + 1]]))]
            flat, spots = text_bytes(texts)
            data = flat.tobytes()
            digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip(spots, spots[1:])]
            columns = [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes.astype(np.int32)), pa.array(levels), pa.array(paths, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_shingles", "shortest", "signature"])

    return _texts(docs).mapInArrow(run, SIGNATURE)


def trie_links(leaves: DataFrame, depth: int) -> DataFrame:
    """Links between documents below a common node, at levels that neither of them has stopped above.

    leaves: tree, path (`depth` values of four bytes), rep, shortest.  The leaves are sorted
    over all tasks by tree, path and rep, so a node is a run of neighbours, which may reach over
    several tasks.  A task links the leaves of a run to its first; rows with a level
    are the ends of a task's runs that a neighbouring task may continue.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["level", "node", "a", "b"]
        running: dict[int, tuple[np.ndarray, int]] = {}  # for each level the node of its last leaf and the run's first leaf
        for batch in batches:
            if not batch.num_rows:
                continue
            rep, stop = batch.column("rep").to_numpy(), batch.column("shortest").to_numpy()
            path = np.frombuffer(b"".join(batch.column("path").to_pylist()), ">u4").reshape(-1, depth).astype(np.int64)
            keys = np.column_stack([batch.column("tree").to_numpy().astype(np.int64), path])
            before, links, ends = np.empty(len(rep), np.int64), [], []
            for level in range(depth, 0, -1):
                on = np.flatnonzero(stop <= level)
                if not len(on):
                    break
                node, mine = keys[on, : level + 1], rep[on]
                new = np.append(True, (node[1:] != node[:-1]).any(axis=1))
                firsts = mine[new]
                if level not in running:
                    ends.append((level, node[0].tobytes(), int(mine[0])))
                elif (running[level][0] == node[0]).all():
                    firsts[0] = running[level][1]
                head = firsts[np.cumsum(new) - 1]
                linked = head != mine
                if level < depth:
                    linked &= head != before[on]  # a link of the level below already says it
                links.append((mine[linked], head[linked]))
                before[on] = head
                running[level] = (node[-1].copy(), int(head[-1]))
            a, b = (np.concatenate(x) for x in zip(*links))
            none = len(a) + len(ends)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None] * len(a) + [e[0] for e in ends], pa.int32()),
                    pa.array([None] * len(a) + [e[1] for e in ends], pa.binary()),
                    pa.array([*a.tolist(), *(e[2] for e in ends)], pa.int64()),
                    pa.array([*b.tolist(), *([None] * (none - len(a)))], pa.int64()),
                ],
                names,
            )
        last = [(level, node.tobytes(), head) for level, (node, head) in running.items()]
        if last:
            columns = [pa.array(c, t) for c, t in zip(zip(*last), (pa.int32(), pa.binary(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(last), pa.int64())], names)

    ordered = leaves.repartitionByRange("tree", "path", "rep").sortWithinPartitions("tree", "path", "rep")
    found = keep(ordered.mapInArrow(run, LINK))
    ends = found.where("level is not null").select("level", "node", "a")
    firsts = ends.groupBy("level", "node").agg(F.min("a").alias("b"))
    across = ends.join(firsts, ["level", "node"]).select("a", "b")
    return found.where("level is null").select("a", "b").unionByName(across).where("a <> b").distinct()


def candidate_groups(distinct: DataFrame, trees: int, depth: int) -> DataFrame:
    """Groups of documents connected by nodes of the forest: columns rep, grp; single documents are left out."""
    size = 4 * depth
    leaves = distinct.select("rep", "shortest", "signature", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    leaves = leaves.select("tree", F.expr(f"substring(signature, tree * {size} + 1, {size})").alias("path"), "rep", "shortest")
    reach = keep(components(trie_links(leaves, depth)))
    roots = reach.select(F.col("component").alias("node"), "component").distinct()
    return reach.unionByName(roots).select(F.col("node").alias("rep"), F.col("component").alias("grp"))


def _pairs_in(rows: np.ndarray, at: np.ndarray, values: np.ndarray, side: np.ndarray, threshold: float):
    """Row numbers of pairs with Jaccard at or above the threshold among `rows` of one group.

    side: rows of equal side, other than -1, are not compared.
    """
    owner = np.repeat(np.arange(len(rows)), at[rows + 1] - at[rows])
    flat = np.concatenate([values[at[r] : at[r + 1]] for r in rows])
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[code] > 1
    owner, code = owner[shared], code[shared]
    if not len(code):
        return
    code = np.unique(code, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    n, width = len(rows), int(code[-1]) + 1
    common = np.zeros((n, n), np.float32)  # counts below 2**24 are exact
    step = max(1, MATRIX_CELLS // n)
    for first in range(0, width, step):
        a, b = np.searchsorted(code, [first, first + step])
        part = np.zeros((n, min(step, width - first)), np.float32)
        part[owner[a:b], code[a:b] - first] = 1
        common += part @ part.T
    sizes = (at[rows + 1] - at[rows]).astype(np.float64)
    union = sizes[:, None] + sizes[None, :] - common
    x, y = np.nonzero(np.triu(common >= threshold * union - 1e-9, 1) & (common > 0))
    apart = (side[rows[x]] != side[rows[y]]) | (side[rows[x]] < 0)
    yield rows[x[apart]], rows[y[apart]]


def verified(members: DataFrame, docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """Exact links of documents of one group: rep, n_links (copies counted), root (least linked document of the task)."""
    weights = members.groupBy("grp").agg(F.sum("n_shingles").alias("w"), F.count("*").alias("m"))
    blocks = F.greatest(F.ceil(F.col("w") / BLOCK_SHINGLES), F.ceil(F.col("m") / (MAX_BLOCK_ROWS // 2))).cast("int")
    weights = weights.select("grp", "w", blocks.alias("blocks"))
    total = weights.agg(F.sum("w")).first()[0] or 0
    bins = max(1, -(-total // BLOCK_SHINGLES))
    placed = members.join(weights, "grp").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    texts = _texts(docs).withColumnRenamed("doc_id", "rep")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            hashes, at = batch_shingles(batch.column("text"), width)
            sets = [np.unique(hashes[a:b]) for a, b in zip(at, at[1:])]
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("rep", "grp", "copies", "blocks", "block")), list_array(flat, ends)],
                ["rep", "grp", "copies", "blocks", "block", "shingles"],
            )

    sets = with_texts(placed.select("rep", "grp", "copies", "blocks", "block"), texts, "rep")
    sets = sets.mapInArrow(cut, "rep long, grp long, copies long, blocks int, block int, shingles array<long>")
    # Small groups share a bin; every two blocks of a large one meet, and a block meets itself.
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    spot = F.when(F.col("blocks") > 1, F.struct(F.col("grp"), F.col("low"), F.col("high"))).otherwise(
        F.struct(F.pmod(F.xxhash64("grp"), F.lit(bins)).alias("grp"), F.lit(-1).alias("low"), F.lit(-1).alias("high"))
    )
    sets = sets.select("rep", "grp", "copies", "block", "shingles", spot.alias("spot")).select("*", "spot.low", "spot.high", F.col("spot.grp").alias("bin")).drop("spot")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("grp", "ascending"), ("rep", "ascending")])
        ids = table.column("rep").to_numpy()
        table = table.filter(pa.array(np.append(True, ids[1:] != ids[:-1])))  # a repeated row is one document
        column = table.column("shingles").combine_chunks()
        at, values = np.asarray(column.offsets).astype(np.int64), np.asarray(column.values)
        reps, grps, copies = (table.column(c).to_numpy() for c in ("rep", "grp", "copies"))
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        side = table.column("block").to_numpy().astype(np.int64) if low != high else np.full(len(reps), -1)
        bounds = [0, *(np.flatnonzero(np.diff(grps)) + 1), len(grps)]
        links, found = np.zeros(len(reps), np.int64), []
        for a, b in zip(bounds, bounds[1:]):
            if b - a > 1:
                for x, y in _pairs_in(np.arange(a, b), at, values, side, threshold):
                    np.add.at(links, x, copies[y])
                    np.add.at(links, y, copies[x])
                    found.append((x, y))
        linked = np.flatnonzero(links)
        root = reps[local_roots(len(reps), found)] if len(linked) else reps
        return pa.table({"rep": reps[linked], "n_links": links[linked], "root": root[linked]})

    return sets.groupBy("bin", "low", "high").applyInArrow(compare, "rep long, n_links long, root long")


def near_duplicates(
    docs: DataFrame,
    width: int = WIDTH,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    depth: int = DEPTH,
    recall: float = RECALL,
) -> DataFrame:
    """Class, number of links and representative of each document.

    docs: doc_id, text; further columns are not read.  Words are lower-cased and
    separated by white space.  Two documents link if the Jaccard similarity of their
    sets of `width`-word shingles is `threshold` or more; a text of fewer words has one
    shingle of all its words; null texts and texts without words link with nothing.
    Documents with equal lower-cased texts are links and are compared as one.  class_id
    is the least doc_id reached by links, n_links counts the documents linked directly,
    kept says whether the row is the one that stays of its class: doc_id = class_id.
    Rows with a null doc_id link with nothing and stay.  A doc_id stands for one text;
    a row that repeats a document counts as one more copy and stays or goes with it.
    An empty table gives no rows.

    Returns doc_id, class_id, n_links, kept.
    """
    shortest = shortest_prefixes(threshold, trees, depth, recall)
    rows = keep(signed(docs.where("doc_id is not null"), width, trees, depth, shortest))
    distinct = (
        rows.where("n_shingles > 0")
        .groupBy("text_key")
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("n_shingles").alias("n_shingles"), F.min("shortest").alias("shortest"), F.min("signature").alias("signature"))
    )
    distinct = keep(distinct)
    groups = candidate_groups(distinct, trees, depth)
    members = keep(distinct.select("rep", "copies", "n_shingles").join(groups, "rep"))
    found = keep(verified(members, docs, width, threshold))
    reach = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("n_links").alias("others"))
    classes = (
        distinct.select("text_key", "rep", "copies")
        .join(links, "rep", "left")
        .join(reach.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "text_key",
            (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("class_id"),
        )
    )
    out = rows.select("doc_id", "text_key").join(classes, "text_key", "left").select("doc_id", "n_links", "class_id")
    out = out.unionByName(docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("class_id")))
    return out.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("doc_id") == F.coalesce("class_id", "doc_id"), F.lit(True)).alias("kept"),
    )

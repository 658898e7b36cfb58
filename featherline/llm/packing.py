"""Best-fit packing planned on the histogram of lengths.

Texts become pieces of at most `capacity` tokens.  Best fit, longest first, runs
over the counts of the lengths: a step places as many pieces of one length as fit
into all sequences with one fill.  The plan has no documents; it says which ranks
within a length go where, and pieces take their places by joining on that rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherline.llm.arrays import chunks
from featherline.llm.ranks import gapless
from featherline.llm.tables import keep
from featherline.llm.tokens import word_encoder

END_ID = 0
RANKS_PER_JOIN_KEY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Step(NamedTuple):
    """Ranks `first` up to `last` (exclusive) of a length, `each` to a sequence from `sequence` on, at `offset`."""

    length: int
    first: int
    last: int
    each: int
    sequence: int
    offset: int


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Cut every document's identifiers, with the end identifier after them, into pieces.

    docs: doc_id, text; further columns are not read.  Null and empty texts have the
    end identifier only.  The file's added tokens in a text keep their own identifiers.
    Whole texts of any length; a document is one row of a task.
    """
    schema = PIECES + (", ids binary" if with_ids else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer, True)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in chunks(batches):
            rows: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1).to_pylist())):
                ids = memoryview(ids + end)
                for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows["doc_id"].append(doc_id)
                    rows["piece"].append(k)
                    rows["start"].append(start)
                    rows["length"].append(len(part) // 4)
                    rows["ids_crc32"].append(zlib.crc32(part))
                    if with_ids:
                        rows["ids"].append(bytes(part))
            arrays = [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["piece"], pa.int32())]
            arrays += [pa.array(rows[k], pa.int64()) for k in ("start", "length", "ids_crc32")]
            if with_ids:
                arrays.append(pa.array(rows["ids"], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, list(rows)[: len(arrays)])

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, schema)


def best_fit(counts: dict[int, int], capacity: int) -> list[Step]:
    """Places for `counts` pieces of each length, longest first, each into the fullest sequence with room."""
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens: sequences from a number on, how many
    left = np.zeros(capacity + 1, bool)
    steps: list[Step] = []
    following = 0

    def put(free: int, sequence: int, count: int) -> None:
        if count and free:
            room.setdefault(free, []).append((sequence, count))
            left[free] = True

    for length in sorted(counts, reverse=True):
        total, done = counts[length], 0
        while done < total:
            fits = np.flatnonzero(left[length:])
            if not len(fits):
                break
            free = length + int(fits[0])
            sequence, count = room[free].pop()
            left[free] = bool(room[free])
            each = free // length
            full = min(count, (total - done) // each)
            if full:
                steps.append(Step(length, done, done + full * each, each, sequence, capacity - free))
                done += full * each
                put(free - each * length, sequence, full)
            rest = min(total - done, each) if full < count else 0
            if rest:
                steps.append(Step(length, done, done + rest, rest, sequence + full, capacity - free))
                done += rest
                put(free - rest * length, sequence + full, 1)
            put(free, sequence + full + bool(rest), count - full - bool(rest))
        each = capacity // length
        full, rest = divmod(total - done, each)
        if full:
            steps.append(Step(length, done, done + full * each, each, following, 0))
            put(capacity - each * length, following, full)
        if rest:
            steps.append(Step(length, done + full * each, total, rest, following + full, 0))
            put(capacity - rest * length, following + full, 1)
        following += full + bool(rest)
    return steps


def place(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add sequence_id and offset to pieces.

    Needs the columns of `pieces`.  Only the histogram, at most `capacity` rows,
    goes to the driver.  An empty table gives no rows.  Repeated rows each get a
    place of their own.
    """
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if counts and max(counts) > capacity:
        raise ValueError("a piece is longer than a sequence")
    schema = "length long, first long, last long, each long, sequence long, offset long"
    plan = cut.sparkSession.createDataFrame(best_fit(counts, capacity), schema)
    key = F.explode(
        F.sequence(
            F.floor(F.col("first") / RANKS_PER_JOIN_KEY), F.floor((F.col("last") - 1) / RANKS_PER_JOIN_KEY)
        )
    ).alias("_key")
    order = ["doc_id", "piece", "ids_crc32"]
    ranked = gapless(cut, ["length"], order, "_rank", sum(counts.values()))
    ranked = ranked.withColumn("_key", F.floor(F.col("_rank") / RANKS_PER_JOIN_KEY))
    nth = F.col("_rank") - F.col("first")
    return (
        ranked.join(plan.select("*", key), ["length", "_key"])
        .where((F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("last")))
        .withColumn("sequence_id", (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long"))
        .withColumn("offset", (F.col("offset") + nth % F.col("each") * F.col("length")).cast("long"))
        .select(*cut.columns, "sequence_id", "offset")
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Every piece of `docs` with its place.  The texts are tokenized once."""
    return place(keep(pieces(docs, tokenizer, capacity)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The identifiers of each sequence, from placed pieces that carry `ids`."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most `capacity` tokens in all
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))

"""Repeated byte strings within and across documents, by sorting suffixes.

A string of `length` bytes that occurs twice holds the same anchor at the same place
in both: of its `GRAM`-byte strings the one with the least hash.  Anchors that occur
once cannot lie in a repeat and go.  Of occurrences with equal surroundings all but
the first are covered as a whole.  The surroundings of the others are dealt by anchor
to shards, and each shard sorts all its suffixes by external induced sorting; a run
of suffixes with common prefixes of `length` bytes or more is one string, and its
first occurrence stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherline.llm.anchors import context_groups, inside, least_positions, prefix_sums, run_hashes
from featherline.llm.arrays import chunks, owners, text_bytes
from featherline.llm.induced import suffix_order
from featherline.llm.tables import keep, with_texts

LENGTH, GRAM = 100, 32
#: Bytes of surroundings that a shard should hold, and memory of its sort before it goes to files.
SHARD_BYTES, SORT_MEMORY = 4 << 20, 128 << 20
#: Places of equal strings that are compared at a time.
RUN_BLOCK = 1 << 20
OCCURRENCES = "anchor long, context long, left int, right int, doc_id long, first int, last int"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _chosen(column: pa.Array, length: int, gram: int):
    """Hash sums of the bytes, where rows begin, the positions of anchors, their hashes and rows."""
    flat, at = text_bytes(column)
    sums = prefix_sums(flat)
    starts = np.arange(max(0, len(flat) - gram + 1))
    hashes = run_hashes(sums, starts, starts + gram)
    spots = least_positions(hashes, inside(at, length), length - gram + 1)
    return sums, at, spots, hashes[spots] if len(spots) else np.zeros(0, np.uint64), np.searchsorted(at, spots, "right") - 1


def _repeated(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Hashes of anchors that occur more than once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            hashes = _chosen(batch.column("text"), length, gram)[3]
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["anchor"])

    return texts.select("text").mapInArrow(run, "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")


def _occurrences(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """All anchors with hashes of their surroundings, which are the bytes first to last (exclusive)."""
    reach, half = length - gram, (length - gram + 1) // 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sums, at, spots, hashes, row = _chosen(batch.column("text"), length, gram)
            low, high = at[:-1][row], at[1:][row]
            begin, end = np.maximum(spots - reach, low), np.minimum(spots + length, high)
            context = run_hashes(sums, begin, end, (spots - begin) * (length * 4) + (end - begin))
            left_at, right_at = np.maximum(spots - half, low), np.minimum(spots + gram + half, high)
            left = run_hashes(sums, left_at, spots + gram, spots - left_at)
            right = run_hashes(sums, spots, right_at, right_at - spots)
            ids = batch.column("doc_id").to_numpy()
            columns = [hashes.view(np.int64), context.view(np.int64), left.astype(np.uint32).view(np.int32), right.astype(np.uint32).view(np.int32), ids[row], (begin - low).astype(np.int32), (end - low).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "context", "left", "right", "doc_id", "first", "last"])

    return texts.mapInArrow(run, OCCURRENCES)


def _surroundings(alive: DataFrame, texts: DataFrame) -> DataFrame:
    """The bytes of each span: anchor, doc_id, first, data."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            out: list[tuple] = []
            for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                data = text.encode()
                out += [(s["anchor"], doc_id, s["first"], data[s["first"] : s["last"]]) for s in spans]
            columns = zip(*out) if out else ((), (), (), ())
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["anchor", "doc_id", "first", "data"])

    spans = alive.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("spans"))
    return with_texts(spans, texts, "doc_id").mapInArrow(run, "anchor long, doc_id long, first int, data binary")


def later_strings(text: np.ndarray, docs: np.ndarray, shift: np.ndarray, length: int, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and start of each string of `length` symbols that occurs at an earlier place of the text.

    docs: the document of each string of the text; shift: what to add to a place in the
    text for the place in the document.  Places are ordered by document, then start.
    """
    order, lcp = suffix_order(text, length, memory)
    ends = np.flatnonzero(text == 0)
    docs_found, starts_found = [], []
    heads = np.flatnonzero(lcp < length)
    sizes = np.diff(np.append(heads, len(order)))
    heads, sizes = heads[sizes > 1], sizes[sizes > 1]

    def places(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        string = np.searchsorted(ends, part)
        return docs[string], part + shift[string]

    # Runs of equal strings, many at a time.
    short = sizes <= RUN_BLOCK
    block = np.cumsum(sizes[short]) // RUN_BLOCK
    cuts = np.flatnonzero(block[1:] != block[:-1]) + 1
    for b, n in zip(np.split(heads[short], cuts), np.split(sizes[short], cuts)) if len(block) else ():
        first = np.cumsum(n) - n
        run = np.repeat(np.arange(len(n)), n)
        doc, start = places(np.asarray(order[(b - first)[run] + np.arange(len(run))]))
        best = np.minimum.reduceat(doc, first)[run]
        best_start = np.minimum.reduceat(np.where(doc == best, start, np.iinfo(np.int64).max), first)[run]
        after = (doc > best) | (start > best_start)  # none lies before the best document
        docs_found.append(doc[after])
        starts_found.append(start[after])
    for b, n in zip(heads[~short].tolist(), sizes[~short].tolist()):  # such a run may be longer than memory
        for first in range(b, b + n, RUN_BLOCK):
            doc, start = places(np.asarray(order[first : min(b + n, first + RUN_BLOCK)]))
            k = np.lexsort((start, doc))[0]
            least = (int(doc[k]), int(start[k])) if first == b else min(least, (int(doc[k]), int(start[k])))
        for first in range(b, b + n, RUN_BLOCK):
            doc, start = places(np.asarray(order[first : min(b + n, first + RUN_BLOCK)]))
            after = (doc > least[0]) | ((doc == least[0]) & (start > least[1]))
            docs_found.append(doc[after])
            starts_found.append(start[after])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(docs_found), np.concatenate(starts_found)) if docs_found else (empty, empty)


def _sorted_shards(parts: DataFrame, shards: int, length: int, memory: int) -> DataFrame:
    """Spans of bytes covered by strings that start earlier, from the surroundings dealt to shards by anchor."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, docs, shifts, size = [], [], [], 0
        for batch in batches:
            flat, at = text_bytes(batch.column("data"))
            text = np.zeros(len(flat) + len(at) - 1, np.uint16)
            text[np.arange(len(flat)) + owners(at)] = flat + np.uint16(1)
            begins = at[:-1] + np.arange(len(at) - 1)
            texts.append(text)
            docs.append(batch.column("doc_id").to_numpy())
            shifts.append(batch.column("first").to_numpy() - begins - size)
            size += len(text)
        if size:
            text = np.concatenate(texts)
            del texts
            doc, start = later_strings(text, np.concatenate(docs), np.concatenate(shifts), length, memory)
            order = np.lexsort((start, doc))
            doc, start = doc[order], start[order]
            first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1))[: len(doc)])
            last = np.append(first[1:], len(doc)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(start[first].astype(np.int32)), pa.array((start[last[: len(first)]] + length).astype(np.int32))], ["doc_id", "first", "last"])

    return parts.repartition(shards, "anchor").select("doc_id", "first", "data").mapInArrow(run, "doc_id long, first int, last int")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Spans of UTF-8 bytes (doc_id, first, last exclusive) covered by strings of `length` bytes that also start earlier.

    docs: doc_id, text; further columns are not read.  Earlier: in a document with a
    smaller doc_id, or before it in the same one, also overlapping.  Strings do not cross
    documents.  Spans may overlap.  Rows with a null doc_id or text have no spans and are
    nobody's source; a doc_id stands for one text.
    """
    texts = _texts(docs.where("doc_id is not null and text is not null"))
    repeated = keep(_repeated(texts, length, gram))
    rows = keep(_occurrences(texts, length, gram).join(repeated, "anchor"))
    later, alive = context_groups(rows, ["doc_id", "first"])
    alive = keep(alive)
    shards = max(1, -(-alive.count() * (2 * length - gram) // SHARD_BYTES))
    found = keep(_sorted_shards(_surroundings(alive, texts), shards, length, SORT_MEMORY))
    return later.select("doc_id", "first", "last").unionByName(found)


def without_spans(docs: DataFrame, spans: DataFrame, with_text: bool = False) -> DataFrame:
    """Remove spans of bytes: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (bytes) if asked for."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for text, cut in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data, kept, done, count = text.encode(), [], 0, 0
                for first, last in sorted((s["first"], s["last"]) for s in cut or ()):
                    if first > done or not count:
                        kept.append(data[done:first])
                        count += 1
                    done = max(done, last)
                kept.append(data[done:])
                rest = b"".join(kept)
                out["n_bytes"].append(len(data))
                out["n_removed"].append(len(data) - len(rest))
                out["n_spans"].append(count)
                out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    out["kept"].append(rest)
            columns = [batch.column("doc_id"), *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string())]
            if with_text:
                columns.append(pa.array(out["kept"], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *list(out)[: len(columns) - 1]])

    cuts = spans.groupBy("doc_id").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    return with_texts(cuts, _texts(docs), "doc_id", "right").mapInArrow(run, schema)


def dedup_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """What is left of each document without repeated byte strings; see `repeated_spans`.

    Null and empty texts have no bytes.  An empty table gives no rows; repeated rows
    each give one.
    """
    return without_spans(docs, keep(repeated_spans(docs, length, gram)))

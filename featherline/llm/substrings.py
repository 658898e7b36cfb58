"""Repeated passages of words across documents, by fixed-block anchors.

Any window of `window` words covers at least `RUN` consecutive blocks of `BLOCK`
words that begin at multiples of `BLOCK`.  These blocks of a reference document
are its index; of every `RUN` blocks in a row the one with the least hash is
enough, since a copy has the same blocks in a row.  Every rolling window of `BLOCK`
words of every document is a probe, thinned in the same way for each phase.  Hits
are extended: occurrences with equal surroundings need no more than that; for the
others all windows around the block are compared by a 128-bit hash of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherline.llm.anchors import context_groups, inside, least_positions, prefix_sums, run_hashes
from featherline.llm.arrays import chunks, owners, rolling, span_hashes, text_bytes, word_spans
from featherline.llm.tables import keep, with_texts

WINDOW, BLOCK = 50, 5
OCCURRENCES = "anchor long, context long, left int, right int, doc_id long, first int, last int"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _chosen(column: pa.Array, window: int, block: int):
    """Word hashes, the first word of each row, and the positions of chosen blocks with their hashes."""
    flat, at = text_bytes(column)
    begins, ends, first = word_spans(flat, at)
    words = span_hashes(flat, begins, ends)
    blocks = rolling(words, block)
    run = (window - block + 1) // block
    spots = least_positions(blocks, inside(first, run * block, window), run, block)
    row = owners(first)
    return words, first, spots, blocks[spots] if len(spots) else np.zeros(0, np.uint64), row[spots]


def _repeated(texts: DataFrame, window: int, block: int) -> DataFrame:
    """Hashes of probes that occur more than once, at least once as an indexed block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            _, first, spots, hashes, row = _chosen(batch.column("text"), window, block)
            aligned = ((spots - first[row]) % block == 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(aligned)], ["anchor", "block"])

    probes = texts.select("text").mapInArrow(run, "anchor long, block int")
    return probes.groupBy("anchor").agg(F.count("*").alias("n"), F.max("block").alias("block")).where("n > 1 and block = 1").select("anchor")


def _occurrences(texts: DataFrame, window: int, block: int) -> DataFrame:
    """All chosen blocks with hashes of their surroundings; first to last (exclusive): the words around."""
    reach, half = window - block, (window - block + 1) // 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words, at, spots, hashes, row = _chosen(batch.column("text"), window, block)
            low, high = at[:-1][row], at[1:][row]
            sums = prefix_sums(words)
            begin, end = np.maximum(spots - reach, low), np.minimum(spots + window, high)
            context = run_hashes(sums, begin, end, (spots - begin) * (window * 4) + (end - begin))
            left_at, right_at = np.maximum(spots - half, low), np.minimum(spots + block + half, high)
            left = run_hashes(sums, left_at, spots + block, spots - left_at)
            right = run_hashes(sums, spots, right_at, right_at - spots)
            ids = batch.column("doc_id").to_numpy()
            columns = [hashes.view(np.int64), context.view(np.int64), left.astype(np.uint32).view(np.int32), right.astype(np.uint32).view(np.int32), ids[row], (begin - low).astype(np.int32), (end - low).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "context", "left", "right", "doc_id", "first", "last"])

    return texts.mapInArrow(run, OCCURRENCES)


def _windows(alive: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """128-bit hashes of the windows inside the spans of each document, each window once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            out: list[tuple[int, int, bytes]] = []
            for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                words = text.encode().split()
                ends = np.cumsum([len(w) + 1 for w in words]).tolist()
                data = memoryview(b" ".join(words))
                todo = np.zeros(len(words) + 1, bool)
                for s in spans:
                    todo[s["first"] : max(s["first"], s["last"] - window + 1)] = True
                for start in np.flatnonzero(todo[: max(0, len(words) - window + 1)]).tolist():
                    part = data[ends[start - 1] if start else 0 : ends[start + window - 1] - 1]
                    out.append((doc_id, start, xxhash.xxh3_128_digest(part)))
            ids, starts, keys = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(keys, pa.binary())], ["doc_id", "first", "key"])

    spans = alive.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return with_texts(spans, texts, "doc_id").mapInArrow(run, "doc_id long, first int, key binary")


def repeated_spans(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Spans of words (doc_id, first, last exclusive) covered by windows that also start in an earlier document.

    docs: doc_id, text; further columns are not read.  Earlier: a smaller doc_id.
    Words are runs of characters other than space, tab, line feed, vertical tab, form
    feed and carriage return.  Spans may overlap.  Rows with a null doc_id or text have
    no spans and are nobody's source; a doc_id stands for one text.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must cover a whole block")
    texts = _texts(docs.where("doc_id is not null and text is not null"))
    repeated = keep(_repeated(texts, window, block))
    rows = keep(_occurrences(texts, window, block).join(repeated, "anchor"))
    later, alive = context_groups(rows, ["doc_id"])
    windows = keep(_windows(keep(alive), texts, window))
    first = windows.groupBy("key").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("other")).where("source < other")
    hits = windows.join(first.select("key", "source"), "key").where("doc_id > source")
    hits = hits.select("doc_id", "first", (F.col("first") + window).alias("last"))
    return later.select("doc_id", "first", "last").unionByName(hits)


def without_spans(docs: DataFrame, spans: DataFrame, with_text: bool = False) -> DataFrame:
    """Remove spans of words: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space), kept_text if asked for."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            out: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "kept_text")}
            for text, cut in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words = text.encode().split()
                if cut:
                    gone = np.zeros(len(words) + 1, bool)
                    for s in cut:
                        gone[s["first"] : s["last"]] = True
                    kept = [words[i] for i in np.flatnonzero(~gone[:-1]).tolist()]
                else:
                    kept = words
                data = b" ".join(kept)
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept_sha256"].append(hashlib.sha256(data).hexdigest())
                if with_text:
                    out["kept_text"].append(data.decode())
            columns = [batch.column("doc_id"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string())]
            if with_text:
                columns.append(pa.array(out["kept_text"], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *list(out)[: len(columns) - 1]])

    cuts = spans.groupBy("doc_id").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    return with_texts(cuts, _texts(docs), "doc_id", "right").mapInArrow(run, schema)


def dedup_words(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """What is left of each document without repeated passages; see `repeated_spans`.

    Null and empty texts have no words.  An empty table gives no rows; repeated rows
    each give one.
    """
    return without_spans(docs, keep(repeated_spans(docs, window, block)))

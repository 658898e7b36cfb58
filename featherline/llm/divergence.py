"""How the words of a language's sources differ.

A task folds whole documents into stripes: a hash table from language and term to the
number of documents and the occurrences in each source.  A table that has grown to its
limit is spilled, as sorted rows, into the shuffle; there stripes of one key meet in order
and are merged.  Merged stripes, dealt by language and term into blocks, meet the sources
of their language and directly give each source's terms and the divergences of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featherline.llm.arrays import chunks
from featherline.llm.tables import keep

#: A term is kept in a language that has it in so many documents.
LEAST_DOCUMENTS = 10
ONE = 1_000_000_000
TOP_TERMS = 10
#: Counts that a task holds before it spills, and bytes of a text that are cut into terms at a time.
HELD_COUNTS, PIECE_BYTES = 2_000_000, 1 << 20
#: Terms of a block, about, and numbers of a matrix that is worked on at a time.
BLOCK_TERMS, MATRIX_CELLS = 4096, 1 << 18
STRIPES = "lang string, term string, n_docs long, sources array<string>, counts array<long>"
PARTS = "lang string, source string, part string, item string, value decimal(38,0)"
_STRIPE = pa.schema([("lang", pa.string()), ("term", pa.string()), ("n_docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

#: A to Z in lower case; what is no letter of a term becomes a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, of at most about PIECE_BYTES at a time."""
    data = text.encode().translate(_FOLD)
    first = 0
    while first < len(data):
        last = data.find(b" ", first + PIECE_BYTES) if len(data) - first > PIECE_BYTES else len(data)
        last = len(data) if last < 0 else last
        yield data[first:last].split()
        first = last


class _Numbers(dict):
    """Consecutive numbers for keys as they come."""

    def __missing__(self, key):
        self[key] = len(self)
        return self[key]


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the values of each different key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(values[order], at) if len(at) else np.zeros(0, np.int64)


class Stripes:
    """The hash table of a task: numbers for terms of a language, and counts in flat arrays."""

    def __init__(self) -> None:
        self.rows: _Numbers = _Numbers()  # of language and term
        self.sources: _Numbers = _Numbers()
        self.terms: dict[str, _Numbers] = {}
        self.docs: list[np.ndarray] = []  # the row of each term of a document, once a document
        self.cells: list[np.ndarray] = []  # row and source of each occurrence
        self.summed = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(2)]
        self.held = 0

    def add(self, lang: str, source: str, text: str) -> None:
        rows, seen = self.terms.get(lang), []
        if rows is None:
            rows = self.terms[lang] = _LangNumbers(lang, self.rows)
        number = self.sources[source]
        for words in terms_of(text):
            found = np.fromiter(map(rows.__getitem__, words), np.int64, len(words))
            self.cells.append(found << 32 | number)
            seen.append(np.unique(found))
            self.held += len(found)
        if seen:
            self.docs.append(seen[0] if len(seen) == 1 else np.unique(np.concatenate(seen)))

    def fold(self) -> int:
        """Sum what has come since; returns how many counts are held."""
        for k, new in enumerate((self.docs, self.cells)):
            keys, values = self.summed[k]
            if new:
                more = np.concatenate(new)
                self.summed[k] = _summed(np.r_[keys, more], np.r_[values, np.ones(len(more), np.int64)])
                new.clear()
        self.held = sum(len(keys) for keys, _ in self.summed)
        return self.held

    def spill(self) -> Iterator[pa.RecordBatch]:
        """All stripes; the table is empty afterwards."""
        self.fold()
        (rows, n_docs), (cells, counts) = self.summed
        names = list(self.rows)
        sources = pa.array(list(self.sources), pa.string())
        at = np.searchsorted(cells >> 32, np.r_[rows, rows[-1:] + 1])
        step = 1 << 15
        for first in range(0, len(rows), step):
            some = rows[first : first + step]
            keys = [names[k] for k in some.tolist()]
            own = at[first : first + len(some) + 1]
            part = slice(int(own[0]), int(own[-1]))
            offsets = pa.array((own - own[0]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang for lang, _ in keys], pa.string()),
                    pa.array([term.decode() for _, term in keys], pa.string()),
                    pa.array(n_docs[first : first + len(some)]),
                    pa.ListArray.from_arrays(offsets, sources.take(pa.array(cells[part] & 0xFFFFFFFF))),
                    pa.ListArray.from_arrays(offsets, pa.array(counts[part])),
                ],
                schema=_STRIPE,
            )
        self.__init__()


class _LangNumbers(dict):
    """Numbers of the terms of one language among those of all."""

    def __init__(self, lang: str, rows: _Numbers) -> None:
        super().__init__()
        self.lang, self.rows = lang, rows

    def __missing__(self, term: bytes) -> int:
        self[term] = number = self.rows[self.lang, term]
        return number


def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (lang, source, text) into stripes."""
    stripes = Stripes()
    for batch in chunks(batches):
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            stripes.add(lang, source, text)
            if stripes.held > HELD_COUNTS and stripes.fold() > HELD_COUNTS // 2:
                yield from stripes.spill()
    yield from stripes.spill()


def _merge_sorted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One stripe for each key of rows in order of their keys."""
    lang, term = batch.column("lang"), batch.column("term")
    count = batch.num_rows
    new = np.ones(count, bool)
    if count > 1:
        differ = pc.or_(pc.not_equal(lang.slice(1), lang.slice(0, count - 1)), pc.not_equal(term.slice(1), term.slice(0, count - 1)))
        new[1:] = differ.to_numpy(zero_copy_only=False)
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    sizes = pc.list_value_length(batch.column("sources")).to_numpy(zero_copy_only=False)
    names = batch.column("sources").flatten().dictionary_encode()
    width = max(1, len(names.dictionary))
    cells, counts = _summed(
        np.repeat(group, sizes) * width + names.indices.to_numpy(zero_copy_only=False),
        batch.column("counts").flatten().to_numpy(zero_copy_only=False),
    )
    offsets = pa.array(np.searchsorted(cells, np.arange(len(at) + 1) * width).astype(np.int32))
    docs = batch.column("n_docs").to_numpy(zero_copy_only=False)
    heads = pa.array(at)
    return pa.RecordBatch.from_arrays(
        [
            lang.take(heads),
            term.take(heads),
            pa.array(np.add.reduceat(docs, at) if count else docs),
            pa.ListArray.from_arrays(offsets, names.dictionary.take(pa.array(cells % width))),
            pa.ListArray.from_arrays(offsets, pa.array(counts)),
        ],
        schema=_STRIPE,
    )


def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes in order of lang and term into one a key; the last of a batch waits for the next batch."""
    waiting = None
    for batch in batches:
        batch = pa.RecordBatch.from_arrays(batch.columns, schema=_STRIPE)
        if waiting is not None:
            batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
        if batch.num_rows:
            merged = _merge_sorted(batch)
            waiting = merged.slice(merged.num_rows - 1)
            yield merged.slice(0, merged.num_rows - 1)
    if waiting is not None:
        yield waiting


def merged_stripes(docs: DataFrame) -> DataFrame:
    """One stripe for each language and term of at least LEAST_DOCUMENTS documents.

    docs: lang, source, text without nulls.
    """
    folded = docs.select("lang", "source", "text").mapInArrow(fold, STRIPES)
    ordered = folded.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return ordered.mapInArrow(merge, STRIPES).where(F.col("n_docs") >= LEAST_DOCUMENTS)


def group_sizes(docs: DataFrame, stripes: DataFrame) -> DataFrame:
    """Every occurring language and source: lang, source, total, n_terms (of the language), lang_total."""
    groups = docs.groupBy("lang", "source").agg(F.lit(0).cast("long").alias("none"))
    counts = stripes.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    totals = counts.groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("total"))
    of_lang = stripes.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("lang_total"))
    none = F.lit(0).cast("long")
    return (
        groups.join(totals, ["lang", "source"], "left")
        .join(of_lang, "lang", "left")
        .select("lang", "source", *(F.coalesce(c, none).alias(c) for c in ("total", "n_terms", "lang_total")))
    )


def shares(counts: np.ndarray, totals: np.ndarray, n_terms: int) -> np.ndarray:
    """1+floor(ONE*(count+2)/(total+2*n_terms)), exact, also where the product passes 64 bits."""
    below = totals + 2 * n_terms
    above = counts + 2
    if not counts.size or int(above.max()) < (1 << 62) // ONE:
        return 1 + ONE * above // below
    return np.array(1 + ONE * above.astype(object) // below.astype(object), np.int64)


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p-q)*(p-q)/(p+q))."""
    d = p - q
    return d * d // (p + q)


def block_parts(key: tuple, stripes: pa.Table, groups: pa.Table) -> pa.Table:
    """What the terms of a block give: sums for all pairs of sources, and each source's best terms."""
    lang = groups.column("lang")[0].as_py() if groups.num_rows else ""
    order = np.argsort(np.array(groups.column("source").to_pylist(), object)) if groups.num_rows else []
    groups = groups.take(pa.array(np.asarray(order, np.int64)))
    names = groups.column("source").to_pylist()
    totals, n_terms, lang_total = (groups.column(c).to_numpy() for c in ("total", "n_terms", "lang_total"))
    terms = sorted(zip((t.encode() for t in stripes.column("term").to_pylist()), range(stripes.num_rows)))
    stripes = stripes.take(pa.array([k for _, k in terms], pa.int64())).combine_chunks()
    place = {name: k for k, name in enumerate(names)}
    width = len(names)
    sums = np.zeros((width, width), object)
    best: list[list[tuple[int, bytes]]] = [[] for _ in names]
    step = max(1, MATRIX_CELLS // max(1, width))
    for first in range(0, stripes.num_rows, step):
        part = stripes.slice(first, step).combine_chunks()
        sources, counts = (part.column(c).combine_chunks() for c in ("sources", "counts"))
        sizes = pc.list_value_length(sources).to_numpy(zero_copy_only=False)
        matrix = np.zeros((len(sizes), width), np.int64)
        columns = np.fromiter(map(place.__getitem__, sources.flatten().to_pylist()), np.int64)
        matrix[np.repeat(np.arange(len(sizes)), sizes), columns] = counts.flatten().to_numpy(zero_copy_only=False)
        p = shares(matrix, totals, int(n_terms[0]))
        q = shares(matrix.sum(axis=1), lang_total[:1], int(n_terms[0]))
        for k in range(width - 1):
            sums[k, k + 1 :] += differences(p[:, k, None], p[:, k + 1 :]).sum(axis=0).astype(object)
        own = np.where((matrix > 0) & (p > q[:, None]), differences(p, q[:, None]), -1)
        for k in range(width):
            top = np.argsort(-own[:, k], kind="stable")[:TOP_TERMS]
            best[k] += [(int(own[r, k]), terms[first + r][0]) for r in top.tolist() if own[r, k] >= 0]
    rows = [(names[a], "pair", names[b], int(sums[a, b])) for a in range(width) for b in range(a + 1, width)]
    for name, found in zip(names, best):
        found = sorted(found, key=lambda x: (-x[0], x[1]))[:TOP_TERMS]
        rows += [(name, "term", term.decode(), value) for value, term in found]
    source, kind, item, value = zip(*rows) if rows else ((), (), (), ())
    return pa.table(
        {
            "lang": pa.array([lang] * len(rows), pa.string()),
            "source": pa.array(source, pa.string()),
            "part": pa.array(kind, pa.string()),
            "item": pa.array(item, pa.string()),
            "value": pa.array(value, pa.int64()).cast(pa.decimal128(38, 0)),
        }
    )


def audit(docs: DataFrame) -> DataFrame:
    """Divergences of sources and their most typical terms: lang, source, part, item, value, rank.

    docs: text, lang, source; nulls count as '', and further columns are not read.  Rows
    stand for themselves, repeated ones too.  A source without terms has pairs; a language
    without kept terms has pairs of value 0; a language with one source has none.  An empty
    table gives none.  The work is a language's kept terms times the pairs of its sources,
    as many as the result has; the sources of one language must fit into a task.
    """
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    stripes = keep(merged_stripes(texts))
    blocks = max(1, -(-stripes.count() // BLOCK_TERMS))
    groups = keep(group_sizes(texts, stripes)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = stripes.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"), "term", "sources", "counts")
    parts = keep(dealt.groupBy("lang", "block").cogroup(groups.groupBy("lang", "block")).applyInArrow(block_parts, PARTS))
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    both = pairs.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value")
    pair = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    term = parts.where("part = 'term'").select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"))
    best = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked_terms = term.withColumn("rank", best).where(F.col("rank") <= TOP_TERMS)
    return pair.withColumn("rank", best).unionByName(ranked_terms)

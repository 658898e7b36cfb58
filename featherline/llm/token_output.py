"""Documents as token files, in order of doc_id, compressed by a grammar per shard.

Rows are dealt to tasks by ranges of doc_id and sorted; a task encodes its texts, and
writes shards of about SHARD_TOKENS identifiers as files of `repair`.  A written table
names the files in order; what a killed attempt left is in no row of it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featherline.llm import repair
from featherline.llm.arrays import chunks
from featherline.llm.tables import keep
from featherline.llm.token_files import new_folder, open_store
from featherline.llm.tokens import byte_encoder

SHARD_TOKENS = 1 << 20
#: Files whose lengths are summed as one in the first step of the prefix sum.
FILES_PER_BLOCK = 4096
#: Files that one task decodes, one after the other, about.
FILES_PER_TASK = 8
FILES = "part int, nth int, file string"
HEADS = "part int, nth int, file string, n_tokens long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, first_rule: int) -> DataFrame:
    """Write all documents and return the files in order: part, nth, file.

    docs: doc_id, text; further columns are not read.  Null texts are empty documents,
    which have the end identifier only.  Null doc_ids come first.  Rows of one doc_id are
    ordered by a hash of their texts; a range of rows alike in both is one task.
    """
    if end_id >= first_rule:
        raise ValueError("the end identifier must lie below the first rule")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (store, path) = byte_encoder(tokenizer), open_store(folder)
        end = np.array([end_id], "<u4").tobytes()
        part, nth, size = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        parts: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal nth, size
            ids = np.frombuffer(b"".join(parts), "<u4")
            if ids.max() >= first_rule:
                raise ValueError("an identifier is the symbol of a rule")
            name = f"{uuid.uuid4().hex}.repair"
            with store.open_output_stream(f"{path}/{name}") as stream:
                stream.write(repair.pack(doc_ids, ids, np.cumsum([len(x) // 4 for x in parts]), first_rule))
            doc_ids.clear()
            parts.clear()
            nth, size = nth + 1, 0
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([nth - 1], pa.int32()), pa.array([name])], ["part", "nth", "file"])

        for batch in chunks(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1).to_pylist())):
                doc_ids.append(doc_id)
                parts.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= SHARD_TOKENS:
                    yield flush()
        if doc_ids:
            yield flush()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    return keep(texts.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, FILES))


def _each_file(files: DataFrame, run, schema: str) -> DataFrame:
    """Files dealt to tasks, about FILES_PER_TASK each; a task has one file in memory at a time."""
    count = files.count()
    return files.repartition(-(-count // FILES_PER_TASK)).mapInArrow(run, schema) if count else files.sparkSession.createDataFrame([], schema)


def with_starts(files: DataFrame, folder: str) -> DataFrame:
    """Each file's place among all identifiers, from the heads of the files: part, nth, file, start.

    Lengths are summed by blocks of files first, so no task sees all files.
    """

    def heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        for batch in batches:
            counts = []
            for file in batch.column("file").to_pylist():
                with store.open_input_file(f"{path}/{file}") as stream:
                    counts.append(repair.n_identifiers(stream.read(repair.HEAD.size)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], ["part", "nth", "file", "n_tokens"])

    lengths = keep(files.mapInArrow(heads, HEADS))
    block = F.floor(F.col("part") / FILES_PER_BLOCK)
    parts = lengths.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("block", block)
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = parts.groupBy("block").agg(F.sum("n").alias("n")).select("block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("block_start"))
    in_block = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.withColumn("part_start", F.coalesce(F.sum("n").over(in_block), F.lit(0))).join(blocks, "block")
    in_part = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    inside = lengths.withColumn("own", F.coalesce(F.sum("n_tokens").over(in_part), F.lit(0)))
    start = F.col("block_start") + F.col("part_start") + F.col("own")
    return keep(inside.join(begins.select("part", "part_start", "block_start"), "part").select("part", "nth", "file", start.alias("start")))


def read(files: DataFrame, folder: str) -> DataFrame:
    """Each document of the files: doc_id, start (identifiers before it), n_tokens, ids_crc32.

    files: file, start.  All of a file is decoded.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        for batch in batches:
            for file, begin in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with store.open_input_file(f"{path}/{file}") as stream:
                    shard = repair.TokenFile(stream.read())
                ids = memoryview(shard.tokens(0, shard.n_tokens).astype("<u4")).cast("B")
                at = shard.starts.tolist()
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(at, at[1:])]
                columns = [pa.array(shard.doc_ids, pa.int64()), pa.array(shard.starts[:-1] + begin), pa.array(np.diff(shard.starts)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _each_file(files, run, DOCUMENTS)


def documents(docs: DataFrame, tokenizer: str, end_id: int, first_rule: int) -> DataFrame:
    """Write documents to files and read them back: doc_id, start, n_tokens, ids_crc32.

    Repeated rows each give one; an empty table gives none.
    """
    spark: SparkSession = docs.sparkSession
    folder = new_folder(spark)
    open_store(folder)
    return read(with_starts(write(docs, folder, tokenizer, end_id, first_rule), folder), folder)

"""Token counts of documents in flat files of token identifiers without an index.

A file is a row of little-endian unsigned 16-bit identifiers; an end-of-document
identifier follows each document.  A block of a file is a row that says which bytes to
read; a vectorised comparison finds the separators of a block, and a prefix scan over the
blocks of a file, of their numbers of separators and last separators, stitches documents
that cross blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featherline.llm.arrays import chunks, list_array
from featherline.llm.tables import keep
from featherline.llm.tokens import word_encoder
from featherline.session import checkpoint_ready

FILE_TOKENS, BLOCK_TOKENS = 4 << 20, 1 << 20
#: Blocks that one task reads, about.
BLOCKS_PER_TASK = 8
BLOCKS = "file string, block int, first long, n_tokens long, ends array<long>"


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared folder of the session."""
    checkpoint_ready(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tokens/{uuid.uuid4().hex}"


def open_store(folder: str):
    from pyarrow import fs

    if folder.startswith("file:") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    return store, path


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write the identifiers of all documents into flat files of about FILE_TOKENS tokens.

    Returns file, document (its place in the file) and doc_id, written as a table.  Files
    have names of their own for each attempt of a task, and only files of attempts whose
    rows were taken are named in it; a lost executor leaves no half-written file that counts.
    docs: doc_id, text; further columns are not read.  Null texts are empty documents.
    """
    if not 0 <= end_id < 1 << 16:
        raise ValueError("identifiers must fit into 16 bits")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (store, path) = word_encoder(tokenizer, False), open_store(folder)
        end, stream, name, size, document = np.array([end_id], "<u2").tobytes(), None, "", 0, 0
        for batch in chunks(batches):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1).to_pylist())):
                ids = np.frombuffer(ids, "<u4")
                if ids.max(initial=0) >= 1 << 16 or (ids == end_id).any():
                    raise ValueError("an identifier does not fit or is the separator")
                if stream is None or size >= FILE_TOKENS:
                    if stream is not None:
                        stream.close()
                    name, size, document = f"{uuid.uuid4().hex}.tokens", 0, 0
                    stream = store.open_output_stream(f"{path}/{name}")
                stream.write(ids.astype("<u2").tobytes() + end)
                rows.append((name, document, doc_id))
                size, document = size + len(ids) + 1, document + 1
            columns = zip(*rows) if rows else ((), (), ())
            kinds = (pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "document", "doc_id"])
        if stream is not None:
            stream.close()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return keep(texts.mapInArrow(run, "file string, document long, doc_id long"))


def scan_blocks(files: DataFrame, folder: str, end_id: int, block_tokens: int) -> DataFrame:
    """For each block of each file: where it begins, its length, and the places of its separators in the file.

    files: file (its name), length (bytes).  A block is a row that says which bytes to
    read; a task seeks to them, so a file of any size is read by many tasks.
    """
    size = 2 * block_tokens
    odd = F.raise_error(F.concat(F.lit("half an identifier at the end of "), "file"))
    last = F.floor((F.col("length") - 1) / size).cast("int")
    blocks = files.where("length > 0").select("file", F.when(F.col("length") % 2 == 0, F.col("length")).otherwise(odd.cast("long")).alias("length"), F.explode(F.sequence(F.lit(0), last)).alias("block"))
    count = files.agg(F.sum(F.ceil(F.col("length") / size))).first()[0] or 0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        for batch in batches:
            for k in range(batch.num_rows):
                head = batch.slice(k, 1)
                file, length, block = (x.to_pylist()[0] for x in head.columns)
                with store.open_input_file(f"{path}/{file}") as stream:
                    stream.seek(block * size)
                    ids = np.frombuffer(stream.read(min(size, length - block * size)), "<u2")
                first = block * block_tokens
                ends = np.flatnonzero(ids == end_id) + first
                yield pa.RecordBatch.from_arrays(
                    [head.column("file"), head.column("block"), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()), list_array(ends, np.array([0, len(ends)]))],
                    ["file", "block", "first", "n_tokens", "ends"],
                )

    return blocks.repartition(max(1, -(-count // BLOCKS_PER_TASK)), "file", "block").mapInArrow(run, BLOCKS)


def token_counts(spark: SparkSession, folder: str, end_id: int, block_tokens: int = BLOCK_TOKENS, named: DataFrame | None = None) -> DataFrame:
    """Each document of the flat files of a folder: file, document, start, n_tokens, terminated.

    n_tokens is without the separator; an empty document has none.  Tokens after the last
    separator of a file are a document that is not terminated.  Files without a token, and
    folders without files, give no rows.  `named` (file) restricts the files; what a killed
    attempt of a writer left is then not read.  A file with half an identifier is an error.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(folder)
    files = listed.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    if named is not None:
        files = files.join(named.select("file").distinct(), "file", "left_semi")
    blocks = keep(scan_blocks(keep(files), folder, end_id, block_tokens))
    in_file = Window.partitionBy("file").orderBy("block")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    # The scan sees one small row of each block, without its separators.
    stitches = blocks.select("file", "block", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("end")).select(
        "file",
        "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("documents"),
        F.coalesce(F.max("end").over(before), F.lit(-1)).alias("last"),
        F.lead("block").over(in_file).isNull().alias("at_end"),
    )
    size = F.col("first") + F.col("n_tokens")
    marks = F.concat(F.array("last"), "ends")
    stitched = blocks.join(stitches, ["file", "block"]).select("file", "documents", "at_end", size.alias("size"), F.size("ends").alias("n"), marks.alias("marks"))
    is_open = F.col("at_end") & (F.col("size") > F.element_at("marks", -1) + 1)
    stops = F.when(is_open, F.concat("marks", F.array("size"))).otherwise(F.col("marks"))
    found = stitched.select("file", "documents", "n", stops.alias("stops")).select(
        "file", "documents", "n", "stops", F.posexplode(F.slice("stops", F.lit(2), F.size("stops"))).alias("nth", "end")
    )
    start = F.element_at("stops", F.col("nth") + 1) + 1
    return found.select(
        "file",
        (F.col("documents") + F.col("nth")).cast("long").alias("document"),
        start.alias("start"),
        (F.col("end") - start).alias("n_tokens"),
        (F.col("nth") < F.col("n")).alias("terminated"),
    )


def document_tokens(docs: DataFrame, tokenizer: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write documents to flat files and count their tokens from the files: doc_id, n_tokens.

    Repeated rows each give one; an empty table gives none.
    """
    spark = docs.sparkSession
    folder = new_folder(spark)
    open_store(folder)
    written = write_token_files(docs, folder, tokenizer, end_id)
    counts = token_counts(spark, folder, end_id, block_tokens, written)
    return written.join(counts, ["file", "document"]).select("doc_id", "n_tokens")

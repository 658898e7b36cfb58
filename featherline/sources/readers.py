"""Readers for logger files.

A tag's files lie in a folder named after it, or carry the tag as the first
part of their name.  One read covers all tags, so the number of files does not
matter to the plan.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from featherline import schemas


def _path() -> Column:
    return F.col("_metadata.file_path")


def tag_of_folder() -> Column:
    return F.regexp_extract(_path(), r"([^/]+)/[^/]+$", 1)


def tag_of_file() -> Column:
    """The file name up to its first dash, underscore or dot."""
    return F.regexp_extract(_path(), r"([^/_.\-]+)[^/]*$", 1)


def tag_of_split() -> Column:
    """The tag of a folder written per tag (``id=...``); NULL elsewhere."""
    found = F.regexp_extract(_path(), r"/id=([^/]+)/[^/]+$", 1)
    return F.when(found != "", F.url_decode(F.replace(found, F.lit("+"), F.lit("%2B"))))


def _as_declared(found: DataFrame, schema: str) -> list[Column]:
    return [
        (F.col(f"`{f.name}`") if f.name in found.columns else F.lit(None)).try_cast(f.dataType).alias(f.name)
        for f in StructType.fromDDL(schema).fields
    ]


def _files_by_header(reader: DataFrameReader, path: str) -> list[list[str]]:
    """Files under a path in groups of equal first lines; a file without lines is in none.

    One scan of the lines, of which each task keeps the first of a file.
    """
    lines = reader.text(path).select(
        _path().alias("file"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("n")
    )
    first = lines.where((F.col("at") == 0) & (F.trim("value") != "")).groupBy("file").agg(F.min_by("value", "n").alias("header"))
    decoded = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    literal = F.regexp_replace(decoded, r"([\[\]{}*?\\])", r"\\$1")  # the reader takes paths as patterns
    groups = first.groupBy("header").agg(F.array_sort(F.collect_list(literal)).alias("files")).orderBy("header")
    return [r.files for r in groups.collect()]


def by_header(reader: DataFrameReader, path: str, schema: str, *further: Column) -> DataFrame:
    """CSV columns by the name in the header, as declared; absent columns and unreadable values are NULL.

    Files of one path may have different headers: files of equal headers are read together, each
    group by its own names, and the groups are put below one another.  A header is one line.
    """

    def read(paths: str | list[str]) -> DataFrame:
        found = reader.option("header", "true").option("enforceSchema", "false").csv(paths)
        found = found.select("*", *[c.alias(f"_further_{i}") for i, c in enumerate(further)])
        return found.select(*_as_declared(found, schema), *[F.col(f"_further_{i}") for i in range(len(further))])

    groups = _files_by_header(reader, path)
    if len(groups) < 2:
        return read(path)
    return reduce(DataFrame.unionByName, [read(files) for files in groups])


def read_tags(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """Tags that have a file ending in `suffix`, with its path and size."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{suffix}")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select(
            F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("id"),
            F.col("path").alias("file"),
            "length",
        )
    )


def read_union(spark: SparkSession, root: str, suffix: str, schema: str, fmt: str = "csv") -> DataFrame:
    """All tags' files of one kind as one table with an ``id`` column; tags without one are absent."""
    reader = spark.read.option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true")
    if fmt != "csv":
        return reader.schema(schema).format(fmt).load(root).select("*", tag_of_folder().alias("id"))
    return by_header(reader, root, schema, tag_of_folder()).withColumnRenamed("_further_0", "id")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV folder or file with a header, or Parquet, by declared schema."""
    if path.rstrip("/").endswith((".csv", "_csv")):
        return by_header(spark.read, path, schema)
    return spark.read.schema(schema).parquet(path)


def read_acc(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.HOURLY)


def read_pressure(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.PRESSURE)


def read_params(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.PARAMS)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tables written per tag, by declared schema; a tag such as 91D stays text."""
    return spark.read.schema(schema).parquet(path)


def _without_header(lines: DataFrame, header_lines: int) -> DataFrame:
    """Lines (id, file, at, _text) less the first ones of each file; the lines of a block follow one another in a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen = None, 0  # the block that the last line is of, and its lines so far
        for batch in batches:
            if not batch.num_rows:
                continue
            files, at = batch.column("file"), batch.column("at").to_numpy()
            n = np.arange(len(at))
            begins = np.empty(len(at), bool)
            begins[0] = block != (files[0].as_py(), at[0])
            begins[1:] = (at[1:] != at[:-1]) | pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)
            since = np.maximum.accumulate(np.where(begins, n, -1))
            place = np.where(since < 0, seen + n, n - since)
            block, seen = (files[-1].as_py(), at[-1]), int(place[-1]) + 1
            yield batch.select(["id", "_text"]).filter(pa.array((at > 0) | (place >= header_lines)))

    return lines.mapInArrow(run, "id string, _text string")


def light_lines(spark: SparkSession, root: str, suffix: str = ".lux", header_lines: int = 2) -> DataFrame:
    """All lines of light logger text after the header; ``_corrupt_record`` holds a line that cannot be read.

    Lines are day/month/year time and lux, tab-separated; blank lines are left out.  A large file
    is read in many tasks; its header lines must begin in the first block of the file.
    """
    lines = (
        spark.read.option("pathGlobFilter", f"*{suffix}")
        .option("recursiveFileLookup", "true")
        .text(root)
        .select(tag_of_folder().alias("id"), _path().alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("_text"))
    )
    lines = _without_header(lines, header_lines).where(F.trim("_text") != "")
    part = F.split("_text", "\t")
    ts = F.try_to_timestamp(F.try_element_at(part, F.lit(1)), F.lit("dd/MM/yyyy HH:mm:ss"))
    lux = F.trim(F.try_element_at(part, F.lit(2))).try_cast("double")
    return lines.select("id", ts.alias("ts"), lux.alias("lux"), "_text").select(
        "id",
        "ts",
        "lux",
        F.when(F.col("ts").isNull() | F.col("lux").isNull(), F.col("_text")).alias("_corrupt_record"),
    )


def read_light(spark: SparkSession, root: str, suffix: str = ".lux") -> DataFrame:
    """Readable lines of light logger text; `unreadable_light` counts the others."""
    return light_lines(spark, root, suffix).where("_corrupt_record is null").drop("_corrupt_record")


def unreadable_light(spark: SparkSession, root: str, suffix: str = ".lux") -> DataFrame:
    """Lines per tag that `read_light` leaves out, with one of them."""
    bad = light_lines(spark, root, suffix).where("_corrupt_record is not null")
    return bad.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("_corrupt_record").alias("example"))


def read_twilight(spark: SparkSession, root: str, suffix: str = ".csv") -> DataFrame:
    """Twilight label files, quoted or not; times with or without fractions of a second."""
    return (
        spark.read.schema(schemas.TWILIGHT_TEXT)
        .option("header", "true")
        .option("pathGlobFilter", f"*{suffix}")
        .csv(root)
        .select(
            F.coalesce(tag_of_split(), tag_of_file()).alias("id"),
            _path().contains("-labeled").alias("labelled"),
            "series",
            F.col("timestamp").cast("timestamp").alias("timestamp"),
            "value",
            "label",
        )
    )

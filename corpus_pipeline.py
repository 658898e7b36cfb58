"""From raw documents to packed training sequences.

Stages, in this order; each works on all documents that the one before it kept:

1. language: documents whose text has no letters, or of whose words less than half are
   spelled as words of the learned languages they are labelled with, go; a text may mix
   several learned languages;
2. near_duplicates: of each class of near duplicates the document with the least doc_id stays;
3. passages: words of passages of 50 words that an earlier document has are removed;
   the text of a document that loses words becomes the kept words, joined by one
   space; documents that lose all their words go;
4. decontamination: documents that hold a benchmark item go;
5. packing: the kept texts become pieces of sequences of 2048 tokens.

Null and empty texts have no letters, and rows with a null doc_id cannot be followed:
they go in the first stage.  Rows that repeat a document stay or go with it.  Tables
without rows give none.  Columns beyond those of documents are dropped.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featherline.llm import contamination, language, ngram_join, packing, substrings
from featherline.llm.queries import WORD_TOKENIZER
from featherline.llm.ship import ship
from featherline.llm.tables import keep, with_texts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SHARE, CAPACITY = 0.5, 2048


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled documents of the input and keep all that are in a learned language."""
    ship(spark)
    rows = docs.select(*COLUMNS).where("doc_id is not null")
    field = language.fit(language.training_sample(rows.where(language.remainder(4) != 2)))
    return language.known(rows, field, LEAST_SHARE)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    ship(spark)
    kept = keep(ngram_join.near_duplicates(docs).where("kept").select("doc_id").distinct())
    return with_texts(kept, docs.select(*COLUMNS), "doc_id").select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go; untouched texts stay as they are."""
    ship(spark)
    spans = keep(substrings.repeated_spans(docs))
    left = keep(substrings.without_spans(docs, spans, with_text=True).where("n_removed > 0").drop("n_words", "kept_sha256").dropDuplicates(["doc_id"]))
    rows = with_texts(left, docs.select(*COLUMNS), "doc_id", "right")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return (
        rows.withColumn("text", text)
        .where("n_removed is null or text <> ''")
        .withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
        .select(*COLUMNS)
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = keep(contamination.contaminated(docs, items).select("doc_id").distinct())
    marked = with_texts(found.withColumn("found", F.lit(True)), docs.select(*COLUMNS), "doc_id", "right")
    return marked.where("found is null").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the kept documents with its place in a sequence."""
    ship(spark)
    return packing.pack(docs, WORD_TOKENIZER, CAPACITY)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_each_class),
    ("passages", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Learned labels and tokenizer identifiers have no SQL; tests compare the stages with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written as a table for the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

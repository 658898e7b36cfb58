"""The operators as queries over the given tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featherline.llm import contamination, divergence, language, ngram_join, packing, sharding, similarity, substrings, suffixes, token_files, token_output, toxicity, whitening
from featherline.llm.ship import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = 24
#: The end-of-text identifier of the word-level file.
END_OF_TEXT = 49407
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The end of a document in token files, and the first number above the byte-level file's identifiers.
DOCUMENT_END, FIRST_RULE = 2, 50257


def query(run: Callable[[SparkSession, str], DataFrame]):
    @functools.wraps(run)
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(spark, sf_dir)

    QUERIES[run.__name__] = shipped
    return shipped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_bytes(table(spark, sf_dir, "documents"))


@query
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.near_vectors(table(spark, sf_dir, "embeddings"), 0.9)


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER, 2048)


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.document_tokens(table(spark, sf_dir, "documents"), WORD_TOKENIZER, END_OF_TEXT)


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op6_decontamination"] = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^ \t\n\x0B\f\r]+') AS words
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^ \t\n\x0B\f\r]+') AS words
  FROM benchmark
), doc_shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, least(len(words), 1)) + 1)) AS i FROM docs)
), item_shingles AS (
  SELECT DISTINCT item_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 4, least(len(words), 1)) + 1)) AS i FROM items)
), sizes AS (
  SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id
)
SELECT doc_id, item_id, count(*) AS n_shared, n_shingles, count(*) / n_shingles AS containment
FROM doc_shingles JOIN item_shingles USING (shingle) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n_shingles
HAVING 5 * count(*) >= 4 * n_shingles
"""


@query
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_words(table(spark, sf_dir, "documents"))


ORACLES["op8_substring_dedup"] = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS words
  FROM documents
), windows AS (
  SELECT doc_id, first, sha256(array_to_string(words[first:first + 49], ' ')) AS key
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS first FROM texts)
), sources AS (
  SELECT key, min(doc_id) AS source FROM windows GROUP BY key
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(first, first + 50)) AS place
  FROM windows JOIN sources USING (key) WHERE source < doc_id
), marks AS (
  SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id
), parts AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM texts
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n
  FROM parts ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), sharding.even_tree(SHARDS))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op12_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.documents(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, DOCUMENT_END, FIRST_RULE)


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`deviation` is null where the exact number does not fit into a long; `deviation_exact` has it."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), 8)
    return found.withColumn("deviation", F.expr("try_cast(deviation_exact as long)"))


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op11_source_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), words AS (
  SELECT row, lang, source, unnest(terms) AS term FROM docs
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 10
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), groups AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce((SELECT sum(n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN sizes USING (lang)
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v)::HUGEINT AS p
  FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), lang_shares AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang))::HUGEINT AS q
  FROM counts GROUP BY lang, term
), pair_sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT
  FROM shares JOIN lang_shares USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 10
"""

"""The stages of the pipeline against plain versions, on a small corpus of planted cases."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline as pipeline

ENGLISH = "the house and garden were seen by that man with his dog over this hill when rain came down".split()
GERMAN = "das haus und der garten wurden von dem mann mit seinem hund gesehen als regen kam über berg".split()


def prose(rng, words, n):
    """Words with made-up endings, so that passages do not repeat by chance."""
    return [str(rng.choice(words)) + "".join(rng.choice(list("aeiou"), 3)) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = np.random.default_rng(4)
    folder = str(tmp_path_factory.mktemp("corpus"))
    item = prose(rng, ENGLISH, 30)
    passage = prose(rng, ENGLISH, 70)
    texts = {i: prose(rng, (ENGLISH, GERMAN)[i % 2], int(rng.integers(60, 200))) for i in range(60)}
    texts[60] = list(texts[2])
    texts[61] = [*texts[4][:-1], "changed"]
    texts[62] = texts[10][:20] + passage + texts[12][:30]
    texts[63] = prose(rng, ENGLISH, 40) + passage + prose(rng, ENGLISH, 35)
    texts[64] = prose(rng, ENGLISH, 50) + item + prose(rng, ENGLISH, 50)
    rows = [(i, " ".join(t), ("en", "de")[i % 2] if i < 60 else "en", "s", len(" ".join(t))) for i, t in texts.items()]
    rows += [(65, None, "en", "s", 0), (66, "", "en", "s", 0), (67, "12 34", None, None, None), (None, rows[0][1], "en", "s", 1), rows[6]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, passage


def test_stages(spark, corpus):
    folder, texts, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("_lower", pipeline.F.lit("extra"))
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.keep(stage(spark, docs, folder))
        assert docs.columns == pipeline.COLUMNS
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["language"]) == set(range(65))
    assert set(kept["near_duplicates"]) == set(range(65)) - {60, 61}
    want = {i: " ".join(t) for i, t in texts.items() if i not in (60, 61)}
    cut = texts[63]
    want[63] = " ".join(cut[:40] + cut[110:])
    assert kept["passages"] == want
    assert kept["decontamination"] == {i: t for i, t in want.items() if i != 64}
    assert docs.where("doc_id = 63").first().n_chars == len(want[63])
    packed = pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == set(want) - {64}
    assert sorted(tuple(r) for r in pipeline.run(spark, folder).select("doc_id", "piece", "length", "ids_crc32").collect()) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed)


def test_empty_tables(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0

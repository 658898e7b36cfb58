"""Language and toxicity: held-out accuracy, and forward-backward against all label paths."""

from __future__ import annotations

import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from featherline.llm import language, toxicity
from featherline.llm.arrays import text_bytes

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
BIG_DIR = "/root/testdata/sf0.01"


def test_marginals_are_sums_over_all_paths():
    rng = np.random.default_rng(0)
    scores, transition = rng.normal(size=(11, 3)), rng.normal(size=(3, 3))
    at = np.array([0, 4, 4, 5, 11])
    got, moves = language.marginals(scores, at, transition, True)
    want, pairs = np.zeros((11, 3)), np.zeros((3, 3))
    for a, b in zip(at, at[1:]):
        total, mine, steps = 0.0, np.zeros((b - a, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=b - a) if b > a else ():
            weight = np.exp(sum(scores[a + t, y] for t, y in enumerate(path)) + sum(transition[x, y] for x, y in zip(path, path[1:])))
            total += weight
            for t, y in enumerate(path):
                mine[t, y] += weight
            for x, y in zip(path, path[1:]):
                steps[x, y] += weight
        if total:
            want[a:b], pairs = mine / total, pairs + steps / total
    assert np.allclose(got, want) and np.allclose(moves, pairs)


ENGLISH = "the house and the garden were seen by that man with his dog".split()
GERMAN = "das haus und der garten wurden von dem mann mit seinem hund gesehen".split()


def test_switched_text_is_labelled_word_by_word():
    rng = np.random.default_rng(1)
    sample = [(" ".join(rng.choice(words, 60)), name) for words, name in ((ENGLISH, "en"), (GERMAN, "de")) for _ in range(30)]
    field = language.fit(sample, rounds=30)
    text = " ".join([*ENGLISH, *GERMAN, *ENGLISH])
    each, first, share = field.label(*text_bytes(pa.array([text, "", "12 !"])))
    want = ["en"] * len(ENGLISH) + ["de"] * len(GERMAN) + ["en"] * len(ENGLISH)
    assert [field.languages[k] for k in each.argmax(axis=1)] == want
    assert first.tolist() == [0, len(want), len(want), len(want)] and share[1:].sum() == 0


def invented(rng, letters, n):
    """Words of one alphabet of consonants and vowels."""
    return ["".join(rng.choice(list(letters), int(rng.integers(3, 8)))) for _ in range(n)]


def test_every_language_is_learned_also_of_long_texts_only(spark, monkeypatch):
    monkeypatch.setattr(language, "SEQUENCES", 150)
    monkeypatch.setattr(language, "SEQUENCES_EACH", 4)
    rng = np.random.default_rng(7)
    pairs = list(itertools.combinations("bcdfghjklmnpqrstvwxz", 2))
    words = {f"l{i:02d}": invented(rng, "".join(pairs[5 * i]) + "aeiou"[i % 5], 40) for i in range(36)}
    rows, i = [], 0
    for name, own in words.items():
        for _ in range(1 if name == "l35" else 8):
            i += 1
            while language_remainder(i) == 2:
                i += 1
            rows.append((i, " ".join(rng.choice(own, 30_000 if name == "l35" else 60)), name))
    asked = [(100_000 + k, " ".join(rng.choice(own, 60)), None) for k, own in enumerate(words.values())]
    assert len(rows[-1][1].encode()) > language.SAMPLE_TEXT_BYTES
    got = {r.doc_id: r.lang_pred for r in language.identify(rows_of(spark, rows + asked)).collect()}
    assert [got[r[0]] for r in asked] == list(words)


def language_remainder(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4


def test_mixed_texts_are_known_and_foreign_ones_are_not(spark):
    rng = np.random.default_rng(8)
    words = {"a": invented(rng, "bdgae", 60), "b": invented(rng, "klmio", 60), "c": invented(rng, "rstuy", 60)}
    field = language.fit([(" ".join(rng.choice(own, 80)), name) for name, own in words.items() for _ in range(30)], rounds=30)
    mixed = " ".join([*rng.choice(words["a"], 40), *rng.choice(words["b"], 30), *rng.choice(words["c"], 30)])
    new = " ".join(invented(rng, "bdgae", 60))  # mostly words that the sample has not
    foreign = " ".join(invented(rng, "fhjnpqvwxz", 60))
    rows = [(1, mixed, None), (2, new, None), (3, foreign, None), (4, "da", None), (5, "12", None), (6, None, None), (7, " ".join(words["b"]) + " " + foreign[:60], None)]
    kept = language.known(rows_of(spark, rows), field, 0.5)
    assert {r.doc_id for r in kept.collect()} <= {1, 2, 4, 7} and {r.doc_id for r in kept.collect()} >= {1, 2, 7}
    one = language.fit([(" ".join(words["a"]), "a")])
    assert {r.doc_id for r in language.known(rows_of(spark, rows), one, 0.5).collect()} >= {2}
    assert language.known(rows_of(spark, rows), language.fit([]), 0.5).count() == 0


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, score string, held_out int")


def test_language_of_odd_rows(spark):
    rows = [(i, " ".join(np.random.default_rng(i).choice(w, 40)), n) for i in range(60) for w, n in [((ENGLISH, "en"), (GERMAN, "de"))[i % 2]]]
    rows += [(100, None, "en"), (101, "", None), (102, "12 34 !", "de"), (103, "das haus und der garten", None), (None, "the house and the garden", "en"), (104, "das haus " * 40_000, "de"), (0, rows[0][1], "en")]
    got = language.identify(rows_of(spark, rows)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [by_id[i].lang_pred for i in (100, 101, 102, 103, 104, None)] == ["und", "und", "und", "de", "de", "en"]
    assert [by_id[i].score for i in (100, 101, 102)] == [0, 0, 0] and all(0 <= r.score <= 1 for r in got)
    assert all(by_id[i].lang_pred == ("en", "de")[i % 2] for i in range(60))
    nothing = language.identify(rows_of(spark, [(1, "the house", None), (2, None, None)])).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language.identify(rows_of(spark, [])).count() == 0


@pytest.mark.skipif(not os.path.isdir(BIG_DIR), reason="no test tables")
def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{BIG_DIR}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 150 and (got.lang_pred == got.lang).mean() > 0.97


def test_toxic_held_out_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    plain = [f"{a}{b}" for a in "ba do ke li mu".split() for b in "rin tor sel pan gov".split()]
    rows, labels = [], []
    for i in range(500):
        words = list(rng.choice(plain, int(rng.integers(30, 200))))
        if i % 4 == 0:
            for _ in range(max(1, len(words) // 30)):
                words[int(rng.integers(len(words)))] = str(rng.choice(["nastyword", "foulness", "vileterm"]))
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900, None, "en"), (901, "", "en"), (None, rows[0][1], "en"), (902, rows[1][1] * 200, "en"), (0, rows[0][1], "en")]
    labels += [(903, 1), (None, 1), (5, None)]
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, toxic int, text string")
    got = toxicity.classify(rows_of(spark, rows), marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 500]
    assert len(held) > 60 and sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) / len(held) > 0.97
    assert {r.predicted for r in got if r.doc_id in (900, 901, 902)} == {0}
    assert toxicity.classify(rows_of(spark, []), marks).count() == 0
    assert {r.score for r in toxicity.classify(rows_of(spark, rows[:3]), marks.limit(0)).collect()} == {0.0}


def test_dictionaries_are_trained_on_what_is_typical():
    """Subtle words: stems of which no whole word repeats, one in 40 words, among words of like syllables."""
    rng = np.random.default_rng(7)
    syllables = "ba do ke li mu rin tor sel pan gov an ter".split()

    def word():
        return "".join(rng.choice(syllables, int(rng.integers(2, 5))))

    def text(toxic):
        words = [word() for _ in range(int(rng.integers(60, 240)))]
        if toxic:
            for _ in range(max(2, len(words) // 40)):
                words[int(rng.integers(len(words)))] = str(rng.choice(["zelqu", "wophk"])) + word()
        return " ".join(words)

    sample = [(text(k % 2), k % 2) for k in range(600)]
    toxic, ordinary = ([t.encode() for t, x in sample if x == label] for label in (1, 0))
    typical = toxicity.typical_sequences(toxic, ordinary)
    found = [int(k).to_bytes(toxicity.SEQUENCE, "big") for k in typical]
    assert b"zelqu" in found and b"wophk" in found and all(set(f) & set(b"zqwh") for f in found)
    special, plain = toxicity.train_dictionaries(toxic, ordinary)
    assert len(special) == len(plain) and b"zelqu" in special and b"zelqu" not in plain
    scorer = toxicity.fit(sample, {0: 300, 1: 300})
    fresh = [(text(k % 2), k % 2) for k in range(400)]
    score = scorer.score([t.encode() for t, _ in fresh])
    assert np.mean((score >= 0.5) == [x == 1 for _, x in fresh]) > 0.9
    assert scorer.score([b""]).shape == (1,) and (scorer.score([b"", b"ba do"]) < 0.5).all()


def test_windows_are_compressed_in_one_call_as_one_by_one():
    texts = [b"", b"a", b"ba do ke li mu " * 9, b"x" * 32, b"", b"y" * 33, b"z" * 48, b"nasty words " * 30]
    cut = toxicity.Cut(texts)
    parts = [toxicity.windows(text) for text in texts]
    assert cut.counts.tolist() == [len(x) for x in parts]
    calls = []

    class Once:
        def multi_compress_to_buffer(self, data, threads):
            calls.append([data[i].tobytes() for i in range(len(data))])
            return calls[-1]

    assert cut.lengths(Once()).tolist() == [len(w) for x in parts for w in x]
    assert calls == [[w for x in parts for w in x if w]]
    scorer = toxicity.Scorer(b"nasty words " * 100, b"ba do ke li mu " * 80)
    toxic, ordinary = scorer._ready()
    expected = [[len(ordinary.compress(w)) - len(toxic.compress(w)) for w in x] for x in parts]
    assert [d.tolist() for d in scorer.differences(cut)] == expected and max(expected[-1]) > 0
    assert toxicity.Cut([]).lengths(toxic).tolist() == [] and toxicity.Pair([scorer]).score([]).shape == (0,)

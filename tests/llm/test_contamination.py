"""Contained items against exact shingle sets of all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from featherline.llm import contamination


@pytest.mark.parametrize("block", [20_000, 7])
def test_items_against_all_documents(spark, monkeypatch, block):
    monkeypatch.setattr(contamination, "BLOCK_ITEMS", block)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(words, int(rng.integers(5, 180))))) for i in range(30)]
    items += [(50, None), (51, ""), (52, "two words"), (53, items[0][1]), (54, items[0][1].upper()), (0, items[0][1]), (None, items[0][1])]
    rows = []
    for i in range(80):
        text = list(rng.choice(words, int(rng.integers(0, 900))))
        part = items[int(rng.integers(30))][1].split()
        for _ in range(int(rng.integers(0, 4))):
            part[int(rng.integers(len(part)))] = "other"
        cut = int(rng.integers(0, len(text) + 1))
        rows.append((i, " ".join(text[:cut] + part + text[cut:])))
    rows += [(90, None), (91, ""), (92, "Two  words"), (93, items[2][1] + "\n\tx"), (None, items[3][1])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, item_id long, n_shared string")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    want = set()
    for d, text in rows:
        mine = shingles(text)
        for i, item in items:
            theirs = shingles(item)
            if i is not None and theirs and 5 * len(mine & theirs) >= 4 * len(theirs):
                want.add((d, i, len(mine & theirs), len(theirs), len(mine & theirs) / len(theirs)))
    got = [tuple(r) for r in contamination.contaminated(docs, bench).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40
    assert contamination.contaminated(docs.limit(0), bench).count() == 0
    assert contamination.contaminated(docs, bench.limit(0)).count() == 0


def test_short_items_in_long_documents(spark):
    rng = np.random.default_rng(8)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(5 + i % 20))) for i in range(400)]
    items += [(400, "again and " * 60), (401, " ".join(["on", "off"] * 40 + [f"z{j}" for j in range(12)]))]
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i, text in items:
        part = text.split()
        if i == 400:
            part = "again and again and again and".split()
        base = list(rng.choice(words, 1500))
        cut = int(rng.integers(1, 1500))
        rows.append((i, " ".join(base[:cut] + part + base[cut:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i, _ in items} and len(got) == len(items)
    assert all(r.containment == 1 for r in got)


def test_short_items_with_missing_shingles(spark):
    item = [f"a{j}" for j in range(10)]  # six shingles, five must be found
    filler = [f"f{j}" for j in range(300)]
    texts = {1: filler + item[1:] + filler, 2: filler + item[:9] + filler, 3: filler + item[1:9] + filler}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = contamination.contaminated(docs, bench).collect()
    assert sorted((r.doc_id, r.n_shared, r.n_shingles) for r in got) == [(1, 5, 6), (2, 5, 6)]

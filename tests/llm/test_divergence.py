"""The divergence audit against a brute-force version, and its spills and merges."""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from featherline.llm import divergence

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=10):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen, own, all_ = Counter(), defaultdict(Counter), Counter()
        for _, source, words in (d for d in docs if d[0] == lang):
            seen.update(set(words))
            own[source].update(words)
        kept = [t for t, n in seen.items() if n >= least]
        for counts in own.values():
            all_.update({t: counts[t] for t in kept})

        def share(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: share(c) for s, c in own.items()}
        q = share(all_)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in own:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def corpus():
    rng = np.random.default_rng(1)
    words = [*"abcdefghij", "Émile", "éMILE", "ÄB", "中文", "x1y", "it's", "\U0001f600", "a\x00b", "Zz"]
    rows = []
    for _ in range(400):
        lang, source = rng.choice(["en", "de", ""], p=[0.7, 0.2, 0.1]), f"s{rng.choice(5, p=[0.5, 0.2, 0.1, 0.1, 0.1])}"
        rows.append((" ".join(rng.choice(words, int(rng.integers(0, 25)))), lang, source))
    rows += [(None, "en", "empty"), ("", "fr", "alone"), ("few words", "it", "a"), ("few words", "it", "b"), (None, None, None)]
    return rows + [("same text here", "en", None)] * 30 + [("word " * 50_000, "en", "long")]


def test_audit_is_the_brute_force_one(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 5)
    rows = corpus()
    docs = spark.createDataFrame([(k, *r, "x") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string").repartition(6)
    got = sorted(map(tuple, divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == brute(rows)
    assert divergence.audit(docs.limit(0)).count() == 0


def as_batches(rows, size):
    batch = pa.RecordBatch.from_pylist([{"lang": lang or "", "source": source or "", "text": text or ""} for text, lang, source in rows], pa.schema([("lang", pa.string()), ("source", pa.string()), ("text", pa.string())]))
    return [batch.slice(k, size) for k in range(0, batch.num_rows, size)]


@pytest.mark.parametrize("held, piece", [(10, 7), (200, 1 << 20), (1 << 30, 64)])
def test_spilled_stripes_merge_into_the_same(monkeypatch, held, piece):
    monkeypatch.setattr(divergence, "HELD_COUNTS", held)
    monkeypatch.setattr(divergence, "PIECE_BYTES", piece)
    rows = corpus()
    spilled = [r for b in divergence.fold(as_batches(rows, 33)) for r in b.to_pylist()]
    spilled.sort(key=lambda r: (r["lang"], r["term"].encode()))
    batch = pa.RecordBatch.from_pylist(spilled, divergence._STRIPE)
    merged = [r for b in divergence.merge([batch.slice(k, 4) for k in range(0, batch.num_rows, 4)]) for r in b.to_pylist()]
    assert len({(r["lang"], r["term"]) for r in merged}) == len(merged)
    want, n_docs = defaultdict(Counter), Counter()
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        n_docs.update({(lang or "", w) for w in words})
        for w in words:
            want[lang or "", w][source or ""] += 1
    assert {(r["lang"], r["term"]): r["n_docs"] for r in merged} == dict(n_docs)
    assert {(r["lang"], r["term"]): dict(zip(r["sources"], r["counts"])) for r in merged} == {k: dict(c) for k, c in want.items()}


def test_shares_are_exact_beyond_64_bits():
    counts = np.array([0, 5, 1 << 40, 1 << 60])
    for total, terms in itertools.product([1 << 41, 1 << 61], [3, 10**9]):
        want = [1 + 10**9 * (int(c) + 2) // (total + 2 * terms) for c in counts]
        assert divergence.shares(counts, np.full(4, total), terms).tolist() == want

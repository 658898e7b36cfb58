"""Grammar-compressed token files: exact round trips, and random access."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from featherline.llm import repair, token_output

TOKENIZER, END, RULE = public_tokenizers.path("byte_bpe_50k.json"), 2, 50257


def packed(documents, first_rule):
    ids = np.array([x for d in documents for x in d], np.uint32)
    return repair.pack([None if k % 7 == 3 else k for k in range(len(documents))], ids, np.cumsum([len(d) for d in documents]), first_rule), ids


@pytest.mark.parametrize("least, share", [(2, 1), (2, 4), (8, 16)])
def test_round_trips_and_ranges(monkeypatch, least, share):
    monkeypatch.setattr(repair, "LEAST_COUNT", least)
    monkeypatch.setattr(repair, "SHARE", share)
    rng = np.random.default_rng(least)
    same = rng.integers(0, 9, 300).tolist()
    cases = [[[1] * 1000], [[1, 2] * 50, [], [1, 2] * 50], [same] * 40, [rng.integers(0, 3, int(n)).tolist() for n in rng.integers(0, 50, 60)], [[5]], [[], []], []]
    for documents in cases:
        data, ids = packed(documents, 9)
        file = repair.TokenFile(data)
        assert repair.n_identifiers(data) == file.n_tokens == len(ids)
        assert file.doc_ids == [None if k % 7 == 3 else k for k in range(len(documents))]
        assert np.array_equal(file.tokens(0, len(ids)), ids)
        for k, d in enumerate(documents):
            assert file.document(k).tolist() == d
        for first, count in rng.integers(0, max(1, len(ids)), (40, 2)).tolist():
            assert np.array_equal(file.tokens(first, count), ids[first : first + count])


def test_frequent_pairs_become_rules():
    data, ids = packed([[1, 2, 3, 4] * 500], 9)
    assert len(repair.TokenFile(data).symbols) < 20
    assert repair.TokenFile(data).lengths.max() >= 256
    rules = {(int(a), int(b)) for a, b in zip(repair.TokenFile(data).left, repair.TokenFile(data).right)}
    assert rules & {(1, 2), (2, 3), (3, 4)}
    with pytest.raises(ValueError):
        repair.TokenFile(b"x" * repair.HEAD.size)


def plain_rules(documents, first_rule, least, share):
    """The rounds of Re-Pair, with every pair of every round counted."""
    documents, rules = [list(d) for d in documents], []
    while True:
        counts = Counter(pair for d in documents for pair in zip(d, d[1:]))
        top = max(counts.values(), default=0)
        if top < least:
            return rules, [x for d in documents for x in d]
        chosen = {pair for pair, n in counts.items() if n >= max(least, top // share)}
        found = []
        for d in documents:
            found.append([])
            for k, pair in enumerate(zip(d, d[1:])):
                if pair in chosen and k - 1 not in found[-1]:
                    found[-1].append(k)
        used = sorted({(d[k], d[k + 1]) for d, at in zip(documents, found) for k in at})
        number = {pair: first_rule + len(rules) + n for n, pair in enumerate(used)}
        rules += used
        documents = [[number[d[k], d[k + 1]] if k in at else x for k, x in enumerate(d) if k - 1 not in at] for d, at in zip(documents, found)]


@pytest.mark.parametrize("first_rule", [9, 1 << 29])  # numbers of few bits are sorted with their places
def test_pairs_found_rare_are_not_sorted_again(monkeypatch, first_rule):
    rng = np.random.default_rng(3)
    sorted_pairs, sizes = repair._sorted_pairs, []

    def counted(symbols, places, bound):
        sizes.append(len(places))
        return sorted_pairs(symbols, places, bound)

    monkeypatch.setattr(repair, "_sorted_pairs", counted)
    for least, share in [(2, 1), (3, 4), (8, 64)]:
        monkeypatch.setattr(repair, "LEAST_COUNT", least)
        monkeypatch.setattr(repair, "SHARE", share)
        documents = [rng.integers(0, 5, int(n)).tolist() for n in rng.integers(0, 40, 30)]
        ids, ends = np.array([x for d in documents for x in d], np.uint32), np.cumsum([len(d) for d in documents])
        sides, symbols, _ = repair.compress(ids, ends, first_rule)
        assert ([*zip(*sides.tolist())], symbols.tolist()) == plain_rules(documents, first_rule, least, share)
    sizes.clear()
    once = np.arange(20_000)  # each pair of these is alone
    repair.compress(np.r_[once, np.tile([20_001, 20_002], 50)].astype(np.uint32), np.array([20_100]), max(first_rule, 30_000))
    assert sizes[0] == 20_099 and len(sizes) > 1 and max(sizes[1:]) < 200


def test_documents_are_the_tokenizers(spark, monkeypatch):
    monkeypatch.setattr(token_output, "SHARD_TOKENS", 200)
    monkeypatch.setattr(token_output, "FILES_PER_BLOCK", 2)
    odd = [None, "", " ", "  a\n\n b ", "<|endoftext|> x", "## #", "naïve 中文 \U0001f600", "word " * 30_000]
    rows = [(i * 3 % 131 - 20, f"some words {i % 5} " * (i % 17)) for i in range(120)] + list(enumerate(odd, 500)) + [(500, "again"), (None, "no id"), (7, "twice"), (7, "twice")]
    docs = spark.createDataFrame([(*r, "f", 1, 2) for r in rows], "doc_id long, text string, file string, part int, start int").repartition(7)
    got = token_output.documents(docs, TOKENIZER, END, RULE).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = []
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, END], "<u4")
        want.append((-99 if doc_id is None else doc_id, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((-99 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    ids = [-99 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    assert [r.start for r in got] == np.r_[0, np.cumsum([r.n_tokens for r in got])[:-1]].tolist()
    assert token_output.documents(docs.limit(0), TOKENIZER, END, RULE).count() == 0

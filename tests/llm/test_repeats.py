"""Repeated passages against plain searches."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from featherline.llm import anchors, induced, substrings, suffixes
from featherline.llm.induced import suffix_order

SCHEMA = "doc_id long, text string, lang string, anchor string, first string, spans string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y", "z") for i, t in rows], SCHEMA)


def passages(seed, words, joiner=" "):
    """Documents that share passages, copies, near copies and runs of one word."""
    rng = np.random.default_rng(seed)

    def prose(n):
        return [str(w) for w in rng.choice(words, n)]

    shared = [prose(int(n)) for n in rng.integers(20, 140, 5)]
    rows = []
    for i in range(60):
        parts = prose(int(rng.integers(0, 80)))
        for _ in range(int(rng.integers(0, 3))):
            part = list(shared[int(rng.integers(5))])
            cut = int(rng.integers(0, 10))
            if rng.random() < 0.4:
                part[int(rng.integers(len(part)))] = "new"
            parts += part[cut:] + prose(int(rng.integers(0, 20)))
        rows.append((int(i * 7 % 61), joiner.join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (-5, rows[4][1]), (102, joiner.join(["same"] * 300)), (103, joiner.join(["same"] * 120))]
    rows += [(104, None), (105, ""), (None, rows[3][1]), (106, " \n\t "), (107, "é " * 70 + "\x1c  \x0b x"), (108, "é\n" * 70)]
    return rows


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def without_windows(rows, size):
    first = {}
    texts = [(i, words_of(t)) for i, t in rows]
    for i, w in texts:
        for s in range(len(w) - size + 1 if i is not None else 0):
            key = tuple(w[s : s + size])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for s in range(len(w) - size + 1 if i is not None else 0):
            if first[tuple(w[s : s + size])] < i:
                gone[s : s + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((-99 if i is None else i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window, block", [(50, 5), (20, 3)])
def test_words_against_all_windows(spark, window, block):
    vocabulary = [f"w{i}" for i in range(300)]
    for seed in (1, 2):
        rows = passages(seed, vocabulary)
        rows.append(rows[3])  # a repeated row
        got = substrings.dedup_words(frame(spark, rows), window, block).collect()
        mine = sorted((-99 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got)
        assert mine == without_windows(rows, window)
    assert substrings.dedup_words(frame(spark, [])).count() == 0


def without_strings(rows, size):
    first = {}
    texts = sorted(((i, (t or "").encode()) for i, t in rows if i is not None))
    for i, data in texts:
        for s in range(len(data) - size + 1):
            first.setdefault(data[s : s + size], (i, s))
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - size + 1 if i is not None else 0):
            if first[data[s : s + size]] < (i, s):
                gone[s : s + size] = b"\1" * size
        kept = bytes(x for x, g in zip(data, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((-99 if i is None else i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length, gram", [(100, 32), (24, 9)])
def test_bytes_against_all_strings(spark, monkeypatch, length, gram):
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 3000)
    monkeypatch.setattr(suffixes, "SORT_MEMORY", 2000 if gram == 9 else 1 << 20)
    vocabulary = [f"w{i}é" for i in range(300)]
    for seed in (1, 2):
        rows = passages(seed, vocabulary)
        rows += [rows[3], (110, "ab" * 300), (111, "x" * 100), (112, "x" * 99), (113, "x" * 101), (114, rows[5][1] + rows[5][1])]
        got = suffixes.dedup_bytes(frame(spark, rows), length, gram).collect()
        mine = sorted((-99 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
        assert mine == without_strings(rows, length)
    assert suffixes.dedup_bytes(frame(spark, [])).count() == 0


def plain_order(text, cap):
    ends = np.flatnonzero(text == 0)

    def key(i):
        return [(1, int(x)) if x else (0, 0) for x in text[i : ends[np.searchsorted(ends, i)]]] + [(0, i)]

    order = sorted(np.flatnonzero(text).tolist(), key=key)
    common = [0] * len(order)
    for k in range(1, len(order)):
        a, b = order[k - 1], order[k]
        while common[k] < cap and text[a + common[k]] == text[b + common[k]] != 0:
            common[k] += 1
    return order, common


@pytest.mark.parametrize("memory", [10, 300, 1 << 24])
def test_induced_order_in_memory_and_in_files(memory):
    rng = np.random.default_rng(memory)
    for _ in range(60):
        parts: list[int] = []
        for _ in range(int(rng.integers(1, 9))):
            some = rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(1, 40))).tolist()
            parts += [*some, 0, *([some[0]] * int(rng.integers(1, 25))), 0, *some[-7:], 0]
        text, cap = np.array(parts), int(rng.integers(3, 50))
        order, common = suffix_order(text, cap, memory)
        assert (list(order), list(common)) == plain_order(text, cap)


@pytest.mark.parametrize("parts", [1, 5, 2000])
def test_hot_contexts_are_split_from_their_rows(spark, monkeypatch, parts):
    monkeypatch.setattr(anchors, "HOT_PARTS", parts)
    rng = np.random.default_rng(3)
    keys = [(1, 1)] * 200 + [(int(a), int(c)) for a, c in rng.integers(0, 9, (300, 2))]
    rows = [(a, c, c // 3, c % 3, int(rng.integers(0, 80)), i) for i, (a, c) in enumerate(keys)]
    df = spark.createDataFrame(rows, "anchor long, context long, left int, right int, doc_id long, first int")
    least = {}
    for a, c, _, _, d, f in rows:
        least[a, c] = min(least.get((a, c), (d, f)), (d, f))
    later, alive = anchors.context_groups(df, ["doc_id", "first"])
    want = sorted(r for r in rows if (r[4], r[5]) > least[r[0], r[1]])
    columns = ["anchor", "context", "left", "right", "doc_id", "first"]
    assert sorted(tuple(r) for r in later.select(columns).collect()) == want
    firsts = [r for r in rows if (r[4], r[5]) == least[r[0], r[1]]]
    agree = [r for r in firsts if any(o[0] == r[0] and o[1] != r[1] and (o[2] == r[2] or o[3] == r[3]) for o in firsts)]
    assert sorted(tuple(r) for r in alive.select(columns).collect()) == sorted(agree)
    if parts == 5:
        assert "BroadcastHashJoin" in later._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_equal_strings_are_compared_many_runs_at_a_time(monkeypatch, block):
    monkeypatch.setattr(suffixes, "RUN_BLOCK", block)
    rng = np.random.default_rng(block)
    for length in (2, 3, 6):
        strings = [rng.integers(1, 3, int(n)).tolist() for n in rng.integers(1, 40, 12)]
        docs, firsts = rng.integers(-2, 4, len(strings)), rng.integers(0, 9, len(strings))
        text = np.array([x for s in strings for x in (*s, 0)], np.uint16)
        begins = np.cumsum([0, *(len(s) + 1 for s in strings)])[:-1]
        places = {}
        for s, doc, first in zip(strings, docs.tolist(), firsts.tolist()):
            for k in range(len(s) - length + 1):
                places.setdefault(tuple(s[k : k + length]), []).append((doc, first + k))
        expected = sorted(p for found in places.values() for p in found if p > min(found))
        calls, lexsort = [], np.lexsort
        with monkeypatch.context() as patch:
            patch.setattr(np, "lexsort", lambda *x: calls.append(x) or lexsort(*x))
            doc, start = suffixes.later_strings(text, docs, firsts - begins, length, 1 << 20)
        assert sorted(zip(doc.tolist(), start.tolist())) == expected and len(expected) > 20
        assert block < 1 << 20 or len(calls) < 10  # none for each run


def test_two_keys_are_sorted_alike_with_few_and_many_bits():
    rng = np.random.default_rng(5)
    rank, second = rng.integers(0, 9, 300), rng.integers(-1, 4, 300)
    for scale in (1, 1 << 52):
        order, differs = induced._sorted_by(rank * scale, second)
        pairs = [*zip(rank[order].tolist(), second[order].tolist())]
        assert order.tolist() == np.lexsort((second, rank)).tolist()
        assert differs.tolist() == [False, *(a != b for a, b in zip(pairs[1:], pairs))]

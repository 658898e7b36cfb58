"""Sharding and packing against plain Python."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from featherline.llm import packing, ranks, sharding

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, piece string, length string"


def docs(spark, rows):
    """Documents with further columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z") for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "a b"), (None, "no number"), (5, "é Ünï don't 12 " * 900), (6, "w " * 5000)]


def chosen(key: int, tree) -> int:
    def draw(path: str) -> float:
        seed = xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), seed=42)
        value = xxhash.xxh64_intdigest(path.encode(), seed=seed)
        return -np.log(((value >> 11) + 0.5) / (1 << 53))

    weight: dict = defaultdict(float)
    for x in tree:
        for node in ((x.region,), (x.region, x.rack), (x.region, x.rack, x.shard)):
            weight[node] += x.weight
    at: tuple = ()
    for level in range(3):
        children = [n for n in weight if len(n) == level + 1 and n[:level] == at and weight[n] > 0]
        path = "root" if not at else "/".join(map(str, at))
        at = min(children, key=lambda n: draw(f"{path}/{n[-1]}") / weight[n]) if len(children) > 1 else children[0]
    return at[2]


def test_shards_follow_the_tree(spark):
    tree = [sharding.Leaf(0, 0, 0, 2.0), sharding.Leaf(0, 0, 1), sharding.Leaf(0, 1, 2, 0.0), sharding.Leaf(0, 2, 3), sharding.Leaf(1, 0, 4, 3.0)]
    got = sharding.shard_of(spark.range(2000), "id", tree, "shard").collect()
    assert all(r.shard == chosen(r.id, tree) for r in got)
    share = Counter(r.shard for r in got)
    assert share[2] == 0 and abs(share[4] / 2000 - 3 / 7) < 0.05 and abs(share[0] / 2000 - 2 / 7) < 0.05


def test_growth_takes_rows_only_into_the_new_shard(spark):
    tree = sharding.even_tree(24)
    got = sharding.place(docs(spark, [(i, "t" * (i % 50)) for i in range(3000)]), tree).collect()
    moved = [r for r in got if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {24} and 60 < len(moved) < 190
    assert set(r.shard for r in got) == set(range(24))


def test_weight_change_moves_rows_only_into_its_subtree(spark):
    tree = sharding.even_tree(24)
    heavier = [x._replace(weight=2.0) if x.shard == 3 else x for x in tree]
    both = sharding.shard_of(sharding.shard_of(spark.range(3000), "id", tree, "a"), "id", heavier, "b").where("a <> b")
    assert {sharding.even_tree(24)[r.b].region for r in both.collect()} == {0}


def test_slots_sizes_and_odd_rows(spark):
    got = sharding.place(docs(spark, ODD), sharding.even_tree(24)).collect()
    assert len(got) == len(ODD)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in ODD)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert sharding.place(docs(spark, []), sharding.even_tree(24)).count() == 0


def test_gapless_numbers_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_PER_BLOCK", 7)
    df = spark.range(500).selectExpr("if(id % 3 = 0, 1, id % 5) g", "id % 11 o")
    got = ranks.gapless(df, ["g"], ["o"], "n", 500).collect()
    for g in {r.g for r in got}:
        mine = sorted(r.n for r in got if r.g == g)
        assert mine == list(range(len(mine)))


def check_places(rows, capacity):
    spots = defaultdict(list)
    for r in rows:
        spots[r.sequence_id].append((r.offset, r.length))
    for parts in spots.values():
        parts.sort()
        assert parts[0][0] == 0
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
        assert sum(parts[-1]) <= capacity
    return len(spots)


def test_pieces_are_the_tokenizers_ids(spark):
    got = packing.pieces(docs(spark, ODD), TOKENIZER, 64, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    parts = defaultdict(list)
    for r in got:
        parts[r.doc_id].append(r)
        assert r.ids_crc32 == zlib.crc32(r.ids) and 4 * r.length == len(r.ids) and r.start == 64 * r.piece
    for doc_id, text in ODD:
        want = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        mine = sorted(parts[doc_id], key=lambda r: r.piece)
        if doc_id == 3:
            mine = mine[:1]
        assert b"".join(r.ids for r in mine) == want
        assert all(r.length == 64 for r in mine[:-1])


def test_added_tokens_in_texts_keep_their_identifiers(spark):
    texts = ["hello <|endoftext|> world", "A<|startoftext|>b<|endoftext|>", "<|endoftext|><|endoftext|>", "x <|ENDOFTEXT|> y", "e<|endoftext|>\u0301 \u00c9 \u03a3<|endoftext|>'s", "<|endoftext <|endoftext|>|>", "plain", ""]
    got = {r.doc_id: r.ids for r in packing.pieces(docs(spark, list(enumerate(texts))), TOKENIZER, 64, with_ids=True).collect()}
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for i, text in enumerate(texts):
        assert got[i] == np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()


def test_packing_is_gapless_and_tight(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_PER_BLOCK", 16)
    monkeypatch.setattr(packing, "RANKS_PER_JOIN_KEY", 8)
    rows = [*ODD, *((100 + i, "ab " * (i * 7 % 60)) for i in range(400)), *((1000 + i, "same") for i in range(300))]
    cut = packing.pieces(docs(spark, rows), TOKENIZER, 64, with_ids=True).cache()
    got = packing.place(cut, 64).collect()
    assert len(got) == cut.count()
    used = check_places(got, 64)
    assert used <= 1.02 * sum(r.length for r in got) / 64 + 1
    whole = {r.sequence_id: r.ids for r in packing.sequences(packing.place(cut, 64)).collect()}
    for r in got:
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == r.ids
    assert packing.pack(docs(spark, []), TOKENIZER).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_over_counts_is_best_fit_over_pieces(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.integers(1, 40, 300))[::-1]
    free: list[int] = []
    for n in lengths.tolist():
        fits = [k for k, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda k: free[k])] -= n
        else:
            free.append(50 - n)
    steps = packing.best_fit(Counter(lengths.tolist()), 50)
    used = {s.sequence + k for s in steps for k in range(-(-(s.last - s.first) // s.each))}
    assert used == set(range(len(used))) and len(used) == len(free)

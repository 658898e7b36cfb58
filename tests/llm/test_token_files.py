"""Token counts from flat files against the tokenizer and plain splitting."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from featherline.llm import token_files, tokens

BYTES = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER, END = public_tokenizers.path("word_bpe_49k.json"), 49407


def test_counts_are_the_tokenizers(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_TOKENS", 300)
    rows = [(i, "some words " * (i % 17)) for i in range(120)] + [(200, None), (201, ""), (None, "x"), (5, "some words " * 5), (202, "long " * 30_000)]
    docs = spark.createDataFrame([(*r, "f", 1) for r in rows], "doc_id long, text string, file string, document int")
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = sorted((-1 if i is None else i, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    for block in (7, 1 << 18):
        got = token_files.document_tokens(docs, TOKENIZER, END, block).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in got) == want
    assert token_files.document_tokens(docs.limit(0), TOKENIZER, END).count() == 0


@pytest.mark.parametrize("block", [1, 2, 5, 1000])
def test_documents_across_blocks_and_open_ends(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    want = []
    for k in range(6):
        ids = rng.integers(0, 4, int(rng.integers(0, 60))).astype("<u2")
        if k == 4:
            ids = np.append(ids, 0).astype("<u2")
        (tmp_path / f"{k}.tokens").write_bytes(ids.tobytes())
        marks = np.flatnonzero(ids == 0).tolist()
        starts = [0, *(m + 1 for m in marks)]
        want += [(f"{k}.tokens", n, a, b - a, True) for n, (a, b) in enumerate(zip(starts, marks))]
        if starts[-1] < len(ids):
            want.append((f"{k}.tokens", len(marks), starts[-1], len(ids) - starts[-1], False))
    got = token_files.token_counts(spark, str(tmp_path), 0, block).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def odd_texts() -> list[str]:
    """Every code point alone, in a word and at its borders, and random mixtures with all kinds of blanks."""
    points = [chr(c) for c in range(0x3200) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x3200, 0x110000, 97) if not 0xD800 <= c < 0xE000]
    rng = np.random.default_rng(5)
    letters = [*" \n\t\r\x1c\x85\u00a0\u2003aB1!\u00e9\u0301\u03a3\u0130\u094d", "  ", "'s", "<|endoftext|>", "<|startoftext|>"]
    mixed = ["".join(rng.choice(letters, int(rng.integers(0, 14)))) for _ in range(20_000)]
    return [f"a{c}b {c} x{c} {c}y  {c}" for c in points] + mixed


@pytest.mark.parametrize("cached", [1000, 1 << 26])
@pytest.mark.parametrize("path, added", [(TOKENIZER, True), (TOKENIZER, False), (BYTES, True)])
def test_identifiers_are_the_librarys(monkeypatch, path, added, cached):
    monkeypatch.setattr(tokens, "CACHED_BYTES", cached)
    encoder = tokens.byte_encoder.__wrapped__(path) if path == BYTES else tokens.word_encoder.__wrapped__(path, added)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not added
    texts = odd_texts()
    want = [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x for i in range(0, len(texts), 500) for x in encoder.encode_all(texts[i : i + 500])] == want
    whole = "  ".join(texts[:3000])
    monkeypatch.setattr(tokens, "SLICE", 40)
    assert encoder.encode(whole) == np.array(tokenizer.encode(whole, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("make", [lambda: tokens.byte_encoder.__wrapped__(BYTES), lambda: tokens.word_encoder.__wrapped__(TOKENIZER, False)])
def test_words_met_again_are_not_made_again(monkeypatch, make):
    """However many words come once, those that come in each text stay, and marks behind a word cost nothing."""
    monkeypatch.setattr(tokens, "CACHED_BYTES", 40_000)
    encoder, calls = make(), []
    tokenize = encoder.tokenize
    monkeypatch.setattr(encoder, "tokenize", lambda piece: calls.append(piece) or tokenize(piece))
    once = iter(f"{a}{b}{c}qx" for a in "abcdefghijklmno" for b in "abcdefghijklmno" for c in "abcdefghij")
    often = ["frequently", "fa\u00e7ade", "words"]
    for _ in range(100):
        text = " ".join(["first", *(next(once) for _ in range(20)), *often, *(f"{x}," for x in often)])
        assert encoder.encode(text) == encoder._ids([text])[0]
    assert encoder.used <= 40_000
    assert len(calls) <= 2000 + 20 + 60  # besides the others: each frequent word once, a comma in each generation


def test_only_named_files_are_read(spark, tmp_path):
    (tmp_path / "a.tokens").write_bytes(np.array([5, 0, 6, 7, 0], "<u2").tobytes())
    (tmp_path / "killed.tokens").write_bytes(b"abc")
    named = spark.createDataFrame([("a.tokens",)] * 2, "file string")
    got = token_files.token_counts(spark, str(tmp_path), 0, 2, named).collect()
    assert sorted((r.start, r.n_tokens) for r in got) == [(0, 1), (2, 2)]
    with pytest.raises(Exception, match="half an identifier"):
        token_files.token_counts(spark, str(tmp_path), 0, 2).collect()


def test_blocks_of_a_large_file_are_byte_ranges(spark, tmp_path):
    """3 GB, all but a few bytes of it a hole on disk."""
    places = [1, 900_000_000, 1_500_000_000]
    with open(tmp_path / "big.tokens", "wb") as file:
        for place in places:
            file.seek(2 * place)
            file.write(np.array([9], "<u2").tobytes())
        file.truncate(2 * (places[-1] + 3))
    got = token_files.token_counts(spark, str(tmp_path), 9, 1 << 24).orderBy("start").collect()
    assert [(r.start, r.n_tokens, r.terminated) for r in got] == [(0, 1, True), (2, 899_999_998, True), (900_000_001, 599_999_999, True), (1_500_000_001, 2, False)]

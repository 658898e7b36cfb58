"""Language of whole texts by a linear-chain conditional random field over words.

Each word has a label.  Its score is a sum of learned weights of byte n-grams, prefix,
suffix and lexicon; labels of neighbouring words have learned transitions; forward-
backward gives each word's label distribution, also where a text switches language.
The field is fitted on a bounded sample of labelled documents, whose passages are
spliced so that it sees switches; labelling covers all words of all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherline.llm.arrays import chunks, mix, text_bytes

#: Bounds of the sample that the field is fitted on: documents of a language, and bytes of a text; of a
#: longer text a passage of SAMPLE_CHARS characters is taken.  All languages are learned.
SAMPLE_DOCS, SAMPLE_TEXT_BYTES, SAMPLE_CHARS = 150, 100_000, 20_000
#: Spliced passages to fit on, at least, and for each language.
SEQUENCES, SEQUENCES_EACH, SEQUENCE_WORDS, ROUNDS = 600, 10, 120, 60
#: Share of a word's letters that must stand between letters as in the sample of its language.
FAMILIAR = 0.5
#: Share of a language among the occurrences of a word of its lexicon, and least occurrences.
LEXICON_SHARE, LEXICON_COUNT = 0.9, 3
BITS, ORDERS, AFFIX = 15, (1, 2, 3, 4), 3
CHUNK = 2 << 20
UNKNOWN = "und"
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_WORDS = re.compile(rb"[a-z\x80-\xff]+").findall
_SLOTS = 1 << BITS


def _slots(x: np.ndarray, seed: int) -> np.ndarray:
    return ((x * np.uint32(0x9E3779B1 + 2 * seed)) >> np.uint32(32 - BITS)).astype(np.int32)


class Words:
    """Words of a batch: runs of letters of lower-cased texts, and what their features need."""

    def __init__(self, flat: np.ndarray, at: np.ndarray) -> None:
        letter = _LETTER[flat]
        edge = np.zeros(len(flat) + 1, bool)
        edge[at] = True
        before = np.append(False, letter)[:-1]
        begins = letter & (edge[:-1] | ~before)
        self.letters = flat[letter].astype(np.uint32)
        self.starts = np.flatnonzero(begins[letter])
        self.at = np.searchsorted(np.flatnonzero(begins), at)  # first word of each row
        self.ends = np.append(self.starts[1:], len(self.letters))[: len(self.starts)]

    def only(self, nth: np.ndarray) -> Words:
        """Some of the words, as one row."""
        out = object.__new__(Words)
        sizes = (self.ends - self.starts)[nth]
        out.ends = np.cumsum(sizes)
        out.starts = out.ends - sizes
        out.letters = self.letters[np.arange(int(sizes.sum())) + np.repeat(self.starts[nth] - out.starts, sizes)]
        out.at = np.array([0, len(nth)])
        return out

    def grams(self, order: int) -> np.ndarray:
        """The slot of the n-gram that begins at each letter; `_SLOTS` if the word ends before."""
        n = len(self.letters)
        code = np.zeros(n, np.uint32)
        for j in range(min(order, n)):
            code[: n - j] = code[: n - j] * np.uint32(263) + self.letters[j:] + np.uint32(1)
        out = _slots(code, order)
        for j in range(1, order):
            out[np.maximum(self.ends - j, self.starts)] = _SLOTS  # the last letters begin no such n-gram
        return out

    def triples(self) -> np.ndarray:
        """Each letter with its neighbours in the word, 0 beyond the word's ends."""
        before, after = np.roll(self.letters, 1), np.roll(self.letters, -1)
        before[self.starts] = 0
        after[self.ends - 1] = 0
        return before << np.uint32(16) | self.letters << np.uint32(8) | after

    def affixes(self) -> list[np.ndarray]:
        """Slots of each word's first and last letters."""
        out = []
        for side in (0, 1):
            code = np.zeros(len(self.starts), np.uint32)
            for j in range(AFFIX):
                place = self.starts + j if side == 0 else self.ends - 1 - j
                inside = (place < self.ends) & (place >= self.starts)
                code = code * np.uint32(263) + np.where(inside, self.letters[np.clip(place, 0, len(self.letters) - 1)] + 1, 0).astype(np.uint32)
            out.append(_slots(code, 7 + side))
        return out

    def keys(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        n, code = len(self.letters), np.zeros(len(self.starts), np.uint64)
        if n:
            place = np.arange(n) - np.repeat(self.starts, self.ends - self.starts)
            weight = mix(place.astype(np.uint64) + np.uint64(3)) | np.uint64(1)
            code = np.add.reduceat((self.letters + np.uint32(1)).astype(np.uint64) * weight, self.starts)
        return mix(code + (self.ends - self.starts).astype(np.uint64))


def marginals(
    scores: np.ndarray, at: np.ndarray, transition: np.ndarray, count_moves: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Label distributions of all words by forward-backward, and expected transitions if asked for.

    scores: [words, labels]; at: the first word of each row.  The words of all rows at one
    place are handled together, longest rows first.
    """
    lengths = np.diff(at)
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    longest = int(lengths.max(initial=0))
    count = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), "right")
    offset = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    spot = offset[np.arange(len(scores)) - at[:-1][row]] + rank[row]
    emit = np.empty_like(scores)
    emit[spot] = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(transition).astype(scores.dtype)
    forward = np.empty_like(emit)
    state = None
    for t in range(longest):
        a, b = offset[t], offset[t + 1]
        state = emit[a:b] if state is None else (state[: b - a] @ step) * emit[a:b]
        state = state / state.sum(axis=1, keepdims=True)
        forward[a:b] = state
    back = np.ones((0, scores.shape[1]), scores.dtype)
    moves = np.zeros_like(step)
    for t in range(longest - 1, -1, -1):
        a, b = offset[t], offset[t + 1]
        if t + 1 < longest:
            known = len(back)
            message = back * emit[b : b + known]
            here = message @ step.T
            if count_moves:
                pair = forward[a : a + known]
                moves += (pair / (pair * here).sum(axis=1, keepdims=True)).T @ message
            here /= here.sum(axis=1, keepdims=True)
            back = np.concatenate([here, np.ones((b - a - known, scores.shape[1]), scores.dtype)])
        else:
            back = np.ones((b - a, scores.shape[1]), scores.dtype)
        forward[a:b] *= back
    out = forward[spot]
    return out / out.sum(axis=1, keepdims=True), moves * step


class Field:
    """The fitted field."""

    def __init__(self, languages: list[str]) -> None:
        k = len(languages)
        self.languages = languages
        self.grams = {n: np.zeros((_SLOTS + 1, k), np.float32) for n in ORDERS}
        self.affix = [np.zeros((_SLOTS + 1, k), np.float32) for _ in range(2)]
        self.lexicon_keys = np.zeros(0, np.uint64)
        self.lexicon_of = np.zeros(0, np.int64)
        self.lexicon = np.zeros((k + 1, k), np.float32)
        self.transition = np.zeros((k, k), np.float32)
        self.triples = np.zeros(0, np.uint32)  # of the sample, and the languages that have each
        self.triple_in = np.zeros((0, k), bool)

    def familiar(self, words: Words) -> np.ndarray:
        """Whether each word is spelled as words of each language: [words, languages]."""
        if not len(self.triples) or not len(words.starts):
            return np.zeros((len(words.starts), len(self.languages)), bool)
        found = words.triples()
        place = np.minimum(np.searchsorted(self.triples, found), len(self.triples) - 1)
        seen = self.triple_in[place] & (self.triples[place] == found)[:, None]
        counts = np.add.reduceat(seen.astype(np.float32), words.starts, axis=0)
        return counts >= FAMILIAR * (words.ends - words.starts)[:, None]

    def entries(self, words: Words) -> np.ndarray:
        """The language in whose lexicon each word is; the number of languages if in none."""
        none = len(self.languages)
        if not len(self.lexicon_keys):
            return np.full(len(words.starts), none)
        keys = words.keys()
        place = np.minimum(np.searchsorted(self.lexicon_keys, keys), len(self.lexicon_keys) - 1)
        return np.where(self.lexicon_keys[place] == keys, self.lexicon_of[place], none)

    def scores(self, words: Words) -> np.ndarray:
        if not len(words.starts):
            return np.zeros((0, len(self.languages)), np.float32)
        total = np.zeros((len(words.letters), len(self.languages)), np.float32)
        for n, table in self.grams.items():
            total += table[words.grams(n)]
        out = np.add.reduceat(total, words.starts, axis=0)
        for table, slots in zip(self.affix, words.affixes()):
            out += table[slots]
        return out + self.lexicon[self.entries(words)]

    def label(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's label distribution, each row's first word, and each row's mean distribution."""
        each, first, _ = self._labelled(flat, at)
        return each, first, _means(each, first)

    def learned(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The share of each row's words that are spelled as words of the languages they are labelled with.

        Summed over the languages, so a text that mixes learned languages counts in full.
        """
        each, first, spelled = self._labelled(flat, at)
        return _means((each * spelled).sum(axis=1, keepdims=True), first)[:, 0]

    def _labelled(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, k = Words(flat, at), len(self.languages)
        if not len(words.starts) or not k:
            return np.zeros((len(words.starts), k)), words.at, np.zeros((len(words.starts), k), bool)
        _, nth, same = np.unique(words.keys(), return_index=True, return_inverse=True)
        distinct = words.only(nth)
        each, _ = marginals(self.scores(distinct)[same], words.at, self.transition)
        return each, words.at, self.familiar(distinct)[same]


def _means(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Means over the words of each row; zeros for rows without words."""
    out = np.zeros((len(first) - 1, values.shape[1]))
    filled = np.diff(first) > 0
    if filled.any():
        out[filled] = np.add.reduceat(values.astype(np.float64), first[:-1][filled], axis=0) / np.diff(first)[filled, None]
    return out


def fit(sample: list[tuple[str, str]], rounds: int = ROUNDS, seed: int = 0) -> Field:
    """Fit the field on (text, language) pairs by Adam on the likelihood of spliced passages.

    Time grows with the square of the languages, beyond 60 of them; about two minutes at 36.
    """
    texts = [(_WORDS(text.lower().encode()), language) for text, language in sample]
    texts = [(words, language) for words, language in texts if words]
    field = Field(sorted({language for _, language in texts}))
    k = len(field.languages)
    number = {language: i for i, language in enumerate(field.languages)}
    spelled: list[np.ndarray] = [np.zeros(0, np.uint32)] * k
    for words, language in texts:
        flat = np.frombuffer(b" ".join(words), np.uint8)
        triples = Words(flat, np.array([0, len(flat)])).triples()
        spelled[number[language]] = np.union1d(spelled[number[language]], triples)
    field.triples = np.unique(np.concatenate([np.zeros(0, np.uint32), *spelled]))
    field.triple_in = np.stack([np.isin(field.triples, each) for each in spelled], axis=1) if k else field.triple_in
    if k < 2:
        return field
    counts = [Counter() for _ in range(k)]
    by_label: list[list[list[bytes]]] = [[] for _ in range(k)]
    for words, language in texts:
        counts[number[language]].update(words)
        by_label[number[language]].append(words)
    total = Counter()
    for c in counts:
        total.update(c)
    entries = [(w, i) for i, c in enumerate(counts) for w, n in c.items() if n >= LEXICON_COUNT and n >= LEXICON_SHARE * total[w]]
    if entries:
        flat = np.frombuffer(b" ".join(w for w, _ in entries), np.uint8)
        keys = Words(flat, np.array([0, len(flat)])).keys()
        order = np.argsort(keys)
        field.lexicon_keys, field.lexicon_of = keys[order], np.array([i for _, i in entries])[order]
    rng = np.random.default_rng(seed)
    sequences, labels = [], []
    for _ in range(max(SEQUENCES, SEQUENCES_EACH * k)):
        words: list[bytes] = []
        while len(words) < SEQUENCE_WORDS:
            label = int(rng.integers(k))
            source = by_label[label][int(rng.integers(len(by_label[label])))]
            start, size = int(rng.integers(len(source))), int(rng.integers(5, 60))
            words += source[start : start + size]
            labels += [label] * len(source[start : start + size])
        sequences.append(b" ".join(words))
    flat = np.frombuffer(b"".join(sequences), np.uint8)
    words = Words(flat, np.cumsum([0, *map(len, sequences)]))
    gold = np.array(labels)
    target = np.zeros((len(gold), k), np.float32)
    target[np.arange(len(gold)), gold] = 1
    inner = np.ones(len(gold), bool)
    inner[words.at[:-1]] = False
    moves = np.zeros((k, k), np.float32)
    np.add.at(moves, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
    grams = {n: words.grams(n) for n in ORDERS}
    affixes, lexicon = words.affixes(), field.entries(words)
    owner = np.repeat(np.arange(len(words.starts)), words.ends - words.starts)
    weights = [*field.grams.values(), *field.affix, field.lexicon, field.transition]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]

    def gathered(slots: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(slots, rows[:, i], size) for i in range(k)], axis=1).astype(np.float32)

    for turn in range(1, rounds + 1):
        each, expected = marginals(field.scores(words), words.at, field.transition, True)
        miss = target - each
        spread = miss[owner]
        gradients = [gathered(grams[n], spread, _SLOTS + 1) for n in ORDERS]
        gradients += [gathered(slots, miss, _SLOTS + 1) for slots in affixes]
        gradients += [gathered(lexicon, miss, k + 1), moves - expected]
        for w, g, m, v in zip(weights, gradients, first, second):
            g = g - 0.02 * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += 0.05 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-6)
        for n in ORDERS:
            field.grams[n][_SLOTS] = 0
    return field


def training_sample(labelled: DataFrame) -> list[tuple[str, str]]:
    """About SAMPLE_DOCS texts of every language, chosen by a hash; all texts of a rarer one.

    labelled: doc_id, text, lang.  Texts of up to SAMPLE_TEXT_BYTES are taken whole, of a longer
    one a passage that begins at a place given by the hash.  Repeated rows count once.
    """
    rows = labelled.where("lang is not null and text is not null")
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return []
    key = F.xxhash64(F.lit("sample"), F.coalesce(F.col("doc_id").cast("string"), "text"))
    rates = F.create_map(*(F.lit(x) for r in counts for x in (r.lang, min(1.0, SAMPLE_DOCS / r["count"]))))
    start = (F.pmod(key, F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))) + 1).cast("int")
    passage = F.when(F.octet_length("text") <= SAMPLE_TEXT_BYTES, F.col("text")).otherwise(F.substring("text", start, F.lit(SAMPLE_CHARS)))
    chosen = rows.where(F.pmod(key, F.lit(1 << 20)) / float(1 << 20) < rates[F.col("lang")])
    chosen = chosen.groupBy("lang", key.alias("key")).agg(F.min(passage).alias("text")).collect()
    return [(r.text, r.lang) for r in sorted(chosen, key=lambda r: (r.lang, r.key, r.text))]


def predict(docs: DataFrame, field: Field, held_out) -> DataFrame:
    """Language of each document: the label with the greatest mean probability over its words, and that mean.

    docs: doc_id, text; further columns are not read.  Null texts and texts without
    letters are `und` with score 0; so are all if no language was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        names = np.array([*field.languages, UNKNOWN], object)
        for batch in chunks(batches, limit=CHUNK):
            share = field.label(*text_bytes(batch.column("text")))[2]
            known = batch.column("lettered").to_numpy(zero_copy_only=False) & (share.sum(axis=1, initial=0) > 0)
            best = np.where(known, share.argmax(axis=1) if share.shape[1] else 0, len(field.languages))
            score = np.where(known, np.minimum(share.max(axis=1, initial=0), 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), text.rlike(r"\p{L}").alias("lettered"), F.lower(text).alias("text"))
    return rows.mapInArrow(run, RESULT)


def known(docs: DataFrame, field: Field, least: float) -> DataFrame:
    """The rows of docs with at least the share `least` of their words in learned languages, as they are.

    Words of several learned languages count together.  Texts without letters are in none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    width = len(docs.columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in chunks(batches, "_lower", CHUNK):
            share = field.learned(*text_bytes(batch.column("_lower")))
            good = (share >= least) & (share > 0)
            yield batch.select(range(width)).filter(pa.array(good))

    text = F.coalesce("text", F.lit(""))
    rows = docs.where(text.rlike(r"\p{L}")).withColumn("_lower", F.lower(text))
    return rows.mapInArrow(run, docs.schema)


def remainder(parts: int):
    """crc32 of the doc_id as text, modulo `parts`; null ids count as empty."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts


def identify(docs: DataFrame) -> DataFrame:
    """Fit on three quarters of the labelled documents and label all.

    docs: doc_id, text, lang.  Held out: crc32(doc_id as text) mod 4 is 2.  Repeated rows
    each give one; an empty table gives none.  Returns doc_id, held_out, lang_pred, score.
    """
    held_out = remainder(4) == 2
    return predict(docs, fit(training_sample(docs.where(~held_out))), held_out)

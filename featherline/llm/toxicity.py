"""Toxicity of whole texts by compression distance.

zstandard trains two dictionaries: one on windows of ordinary text, and one on pieces of
toxic text around byte sequences that stand in clearly more toxic than ordinary texts.
Each window of a text is compressed with the ordinary one, and with both; the ordinary one
is filled up with the same pieces without these sequences, so that what stands around them
makes no difference.  The difference of the lengths says which class a window is closer
to.  Thresholds on the differences, and their weights, are calibrated on labelled texts
that the dictionaries were not trained on.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherline.llm.arrays import chunks
from featherline.llm.language import remainder

#: Bounds of the labelled sample: documents of a class, bytes of a text.
SAMPLE_DOCS, SAMPLE_TEXT_BYTES = 2000, 200_000
WINDOW, STEP = 32, 16
#: Bytes of the common dictionary and of that of a class, and windows that one is trained on.
COMMON_BYTES, CLASS_BYTES, TRAINED_WINDOWS = 8192, 2048, 40_000
#: Lengths of the dictionaries' pieces and of the byte strings by which they are rated.
COMMON_PIECE, CLASS_PIECE, RATED = 50, 16, 6
#: A byte sequence of this length is typical if it stands in this many toxic texts, its shares
#: in the two classes differ by so many standard deviations, and by this factor.
SEQUENCE, LEAST_TEXTS, TYPICAL, FACTOR = 5, 3, 6.0, 5.0
BEFORE, AFTER = 1, 3
#: Shares of ordinary windows that lie below the thresholds on differences.
SHARES = (0.9, 0.99, 0.999)
LOW_THRESHOLDS = (2, 4, 6)
#: Short matches are sought in small tables.
PARAMETERS = {"window_log": 16, "hash_log": 16, "chain_log": 15, "search_log": 3, "min_match": 3, "target_length": 0, "strategy": zstandard.STRATEGY_GREEDY}
RESULT = "doc_id long, held_out boolean, score double, predicted int"


def windows(data: bytes) -> list[bytes]:
    return [data[i : i + WINDOW] for i in range(0, max(1, len(data) - WINDOW + STEP), STEP)]


class Cut:
    """The windows of several texts, as one buffer that zstandard compresses in one call."""

    def __init__(self, texts: list[bytes]) -> None:
        lengths = np.array([len(text) for text in texts], np.int64)
        #: How many windows each text has, and where its first one is.
        self.counts = np.maximum(1, -(-(lengths - WINDOW) // STEP) + 1)
        self.firsts = np.cumsum(self.counts) - self.counts
        inside = STEP * (np.arange(int(self.counts.sum())) - np.repeat(self.firsts, self.counts))
        sizes = np.minimum(np.repeat(lengths, self.counts) - inside, WINDOW)
        # An empty window is as long with every dictionary.
        self.filled = np.flatnonzero(sizes)
        places = np.repeat(np.cumsum(lengths) - lengths, self.counts) + inside
        self.data, self.segments = b"".join(texts), np.stack([places, sizes], axis=1)[self.filled].astype("=u8").tobytes()

    def lengths(self, compressor: zstandard.ZstdCompressor) -> np.ndarray:
        """Of the compressed windows; 0 for empty ones."""
        out = np.zeros(int(self.counts.sum()), np.int64)
        if len(self.filled):
            packed = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(self.data, self.segments), threads=0)
            out[self.filled] = np.fromiter(map(len, packed), np.int64, len(self.filled))
        return out


def _sequences(data: bytes) -> np.ndarray:
    """The numbers of all byte sequences of length SEQUENCE, by where they begin."""
    values = np.frombuffer(data, np.uint8).astype(np.uint64)
    count = max(0, len(values) - SEQUENCE + 1)
    out = np.zeros(count, np.uint64)
    for j in range(SEQUENCE):
        out = out << np.uint64(8) | values[j : j + count]
    return out


def _text_counts(texts: list[bytes], held: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """In how many texts each byte sequence stands."""
    keys, counts, new, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
    for k, text in enumerate(texts):
        new.append(np.unique(_sequences(text)))
        size += len(new[-1])
        if size > held or k == len(texts) - 1:
            keys, where = np.unique(np.concatenate([keys, *new]), return_inverse=True)
            counts = np.bincount(where, np.r_[counts, np.ones(size, np.int64)], len(keys)).astype(np.int64)
            new, size = [], 0
    return keys, counts


def typical_sequences(toxic: list[bytes], ordinary: list[bytes]) -> np.ndarray:
    """The byte sequences that are typical of toxic texts, ascending."""
    keys, mine = _text_counts(toxic)
    other_keys, others = _text_counts(ordinary)
    at = np.minimum(np.searchsorted(other_keys, keys), max(0, len(other_keys) - 1))
    their = np.where(other_keys[at] == keys, others[at], 0) if len(other_keys) else np.zeros(len(keys), np.int64)
    n, m = max(1, len(toxic)), max(1, len(ordinary))
    share = (mine + their) / (n + m)
    distance = (mine / n - their / m) / np.sqrt(share * (1 - share) * (1 / n + 1 / m) + 1e-12)
    return keys[(mine >= LEAST_TEXTS) & (distance >= TYPICAL) & (mine / n >= FACTOR * their / m)]


def _places(text: bytes, typical: np.ndarray) -> list[int]:
    """Where typical sequences begin."""
    found = _sequences(text)
    at = np.minimum(np.searchsorted(typical, found), max(0, len(typical) - 1))
    return np.flatnonzero(typical[at] == found).tolist() if len(typical) else []


def _pieces_around(text: bytes, typical: np.ndarray) -> list[bytes]:
    out, done = [], 0
    for place in _places(text, typical):
        if place >= done:
            out.append(text[max(0, place - BEFORE) : place + SEQUENCE + AFTER])
            done = place + SEQUENCE
    return out


def _trained(samples: list[bytes], size: int, piece: int) -> bytes:
    """A dictionary trained by zstandard; with too few samples for that, the samples themselves."""
    step = max(1, len(samples) // TRAINED_WINDOWS)
    try:
        return zstandard.train_dictionary(size, samples[::step], k=piece, d=RATED).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[:size]


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The two dictionaries, of like size; the last bytes of one find no matches and are blank."""
    typical = typical_sequences(toxic, ordinary)
    special = [piece for text in toxic for piece in _pieces_around(text, typical)] or [w for text in toxic for w in windows(text)]
    common = _trained([w for text in ordinary for w in windows(text)], COMMON_BYTES, COMMON_PIECE)
    own = _trained(special, CLASS_BYTES, CLASS_PIECE)
    # What stands around the typical sequences is ordinary, and in both.
    plain = np.frombuffer(own, np.uint8).copy()
    for place in _places(own, typical) if len(typical) else range(len(own)):
        plain[place : place + SEQUENCE] = ord(" ")
    return tuple(common + part + b" " * 16 for part in (own, plain.tobytes()))


class Scorer:
    """Dictionaries, and the weights of what their differences show."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self.contents = toxic, ordinary
        self.compressors: tuple | None = None
        self.thresholds: list[int] = list(LOW_THRESHOLDS)
        self.usual = [0.0] * len(LOW_THRESHOLDS)
        self.mean, self.spread, self.weights = np.zeros(0), np.ones(0), np.zeros(0)
        self.least, self.most = np.zeros(0), np.zeros(0)
        self.prior = 0.0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"compressors": None}

    def _ready(self) -> tuple:
        if self.compressors is None:
            out = []
            for content in self.contents:
                data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                how = zstandard.ZstdCompressionParameters(**PARAMETERS, write_content_size=False, write_dict_id=False, write_checksum=False)
                data.precompute_compress(compression_params=how)
                out.append(zstandard.ZstdCompressor(compression_params=how, dict_data=data))
            self.compressors = tuple(out)
        return self.compressors

    def differences(self, cut: Cut) -> list[np.ndarray]:
        """Bytes that the toxic dictionary saves against the ordinary one: of each text, window by window."""
        toxic, ordinary = self._ready()
        return np.split(cut.lengths(ordinary) - cut.lengths(toxic), cut.firsts[1:])

    def set_thresholds(self, ordinary: list[np.ndarray]) -> None:
        """From the differences of ordinary texts."""
        found = np.concatenate(ordinary)
        self.thresholds = sorted({*LOW_THRESHOLDS, *np.quantile(found, SHARES).astype(int).tolist()})
        self.usual = [float((found >= t).mean()) for t in self.thresholds]

    def features(self, d: np.ndarray) -> list[float]:
        """Of a text's differences."""
        top = np.sort(d)[::-1][:16]
        over = [np.count_nonzero(d >= t) for t in self.thresholds]
        return [float(top[0]), top[:2].mean(), top[:4].mean(), top.mean(), d.mean(), *(x / len(d) for x in over), *(math.log((x + 1) / (p * len(d) + 1)) for x, p in zip(over, self.usual)), math.log1p(len(d))]

    def calibrate(self, rows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        """Logistic weights by Newton steps; features beyond all seen here will count as the border."""
        self.least, self.most = rows.min(axis=0), rows.max(axis=0)
        self.mean, self.spread = rows.mean(axis=0), rows.std(axis=0) + 1e-9
        x = np.c_[(rows - self.mean) / self.spread, np.ones(len(rows))]
        w = np.zeros(x.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            curve = x.T @ (x * (weights * p * (1 - p))[:, None]) + 0.1 * np.eye(len(w))
            step = np.linalg.solve(curve, x.T @ (weights * (labels - p)) - 0.1 * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def score(self, cut: Cut) -> np.ndarray:
        count = len(cut.counts)
        if not len(self.weights) or not count:
            return np.full(count, self.prior)
        rows = np.array([self.features(d) for d in self.differences(cut)])
        x = (np.clip(rows, self.least, self.most) - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(count)] @ self.weights, -30, 30)))


class Pair:
    """Two scorers, each calibrated on the texts that the other's dictionaries were trained on; scores are their means."""

    def __init__(self, scorers: list[Scorer]) -> None:
        self.scorers = scorers

    def score(self, texts: list[bytes]) -> np.ndarray:
        cut = Cut(texts)
        return np.mean([scorer.score(cut) for scorer in self.scorers], axis=0)


def fit(sample: list[tuple[str, int]], totals: dict[int, int]) -> Pair:
    """Fit on (text, label) pairs; totals: how many labelled documents each class has in all.

    Either half of the texts trains the dictionaries of one scorer, whose thresholds and
    weights are calibrated on the other half; there classes weigh as their totals.  A class
    of one text has it for both.
    """
    texts = {label: [t.lower().encode() for t, x in sample if x == label] for label in (0, 1)}
    scorers = []
    for k in (0, 1):
        trained, held = ({label: t[j::2] or t for label, t in texts.items()} for j in (k, 1 - k))
        scorer = Scorer(*train_dictionaries(trained[1], trained[0]))
        scorer.prior = totals.get(1, 0) / max(1, sum(totals.values()))
        if texts[0] and texts[1]:
            seen = {label: [d for t in held[label] for d in scorer.differences(Cut([t]))] for label in (0, 1)}
            scorer.set_thresholds(seen[0])
            rows = np.array([scorer.features(d) for label in (0, 1) for d in seen[label]])
            labels = np.repeat([0, 1], [len(seen[0]), len(seen[1])])
            weight = np.array([totals.get(label, 1) / len(seen[label]) for label in (0, 1)])[labels]
            scorer.calibrate(rows, labels, weight / weight.mean())
        scorers.append(scorer)
    return Pair(scorers)


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """About SAMPLE_DOCS whole texts of each class by a hash of their number, and the sizes of the classes.

    docs: doc_id, text; labels: doc_id, toxic (0 or 1; others and nulls are no labels; of
    labels that differ the greater counts).  Texts beyond SAMPLE_TEXT_BYTES are not chosen.
    """
    marked = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if not totals:
        return [], {}
    unit = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    rate = F.coalesce(*(F.when(F.col("toxic") == k, F.lit(min(1.0, SAMPLE_DOCS / n))) for k, n in totals.items()))
    chosen = F.broadcast(marked.where(unit < rate).limit(4 * SAMPLE_DOCS))
    texts = docs.select("doc_id", "text").where("text is not null").where(F.octet_length("text") <= SAMPLE_TEXT_BYTES)
    rows = texts.join(chosen, "doc_id").select("text", "toxic", F.xxhash64("doc_id").alias("key")).limit(8 * SAMPLE_DOCS).collect()
    return [(r.text, r.toxic) for r in sorted(rows, key=lambda r: (r.toxic, r.key, r.text))], totals


def predict(docs: DataFrame, scorer: Pair, held_out) -> DataFrame:
    """Score of each document: doc_id, held_out, score, predicted.

    docs: doc_id, text; further columns are not read.  Null texts count as empty; an
    empty text is one empty window.  Without labels of both classes the score is the
    share of toxic labels.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for batch in chunks(batches):
            score = scorer.score([t.encode() for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    text = F.lower(F.coalesce("text", F.lit(""))).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), text).mapInArrow(run, RESULT)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on four fifths of the labels and score all documents.

    Held out: crc32(doc_id as text) mod 5 is 0.  Repeated rows each give one; an empty
    table gives none.
    """
    held_out = remainder(5) == 0
    return predict(docs, fit(*training_sample(docs, labels.where(~held_out))), held_out)

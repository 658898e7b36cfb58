"""Whole Arrow text columns as flat numpy arrays: bytes, words, word hashes and shingles.

All functions work on many documents at once; nothing crosses a document border.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(count: int, seed: int) -> np.ndarray:
    """`count` odd 64-bit multipliers."""
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed)) | np.uint64(1)


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the hash base and of its inverse, up to `length` (exclusive)."""
    global _powers
    if len(_powers[0]) < length:
        size = max(length, CHUNK_BYTES + 1)

        def series(base: int) -> np.ndarray:
            out = np.full(size, base, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        _powers = series(_BASE), series(_INVERSE)
    return _powers[0][:length], _powers[1][:length]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each row begins (one more entry than rows)."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    count = column.offset + len(column) + 1
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, count)[column.offset :]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at.astype(np.int64) - int(at[0])


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds about `limit` bytes of text; one document is never cut."""
    for batch in batches:
        at = text_bytes(batch.column(column))[1]
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def word_spans(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and each row's first word (one more entry than rows)."""
    size = len(flat)
    solid = np.zeros(size + 2, bool)
    np.logical_not(_SPACE[flat], out=solid[1:-1])
    edge = np.zeros(size + 1, bool)
    edge[at] = True
    begins = np.flatnonzero(solid[1:] & (edge | ~solid[:-1]))
    ends = np.flatnonzero(solid[:-1] & (edge | ~solid[1:]))
    return begins, ends, np.searchsorted(begins, at)


def span_hashes(flat: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    up, down = powers(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))


def rolling(values: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """A hash of every `width` consecutive values, by where they begin."""
    count = max(0, len(values) - width + 1)
    out = np.zeros(count, np.uint64)
    for j, factor in enumerate(seeds(width, seed)):
        out += values[j : j + count] * factor
    return mix(out)


def owners(at: np.ndarray) -> np.ndarray:
    """The row of each element of a flat array."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def word_shingles(words: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all `width` consecutive words of each row.

    A row with fewer words, but at least one, has one shingle of all its words.
    """
    lengths = np.diff(at)
    full = rolling(words, width)
    row = owners(at)[: len(full)]
    inside = np.arange(len(full)) + width <= at[1:][row]
    hashes, rows = [full[inside]], [row[inside]]
    for short in range(1, width):
        which = np.flatnonzero(lengths == short)
        if len(which):
            total = np.full(len(which), short, np.uint64)
            for j, factor in enumerate(seeds(short, 1)):
                total += words[at[which] + j] * factor
            hashes.append(mix(total))
            rows.append(which)
    order = np.argsort(np.concatenate(rows), kind="stable") if len(rows) > 1 else slice(None)
    rows = np.concatenate(rows)[order]
    return np.concatenate(hashes)[order], np.searchsorted(rows, np.arange(len(at)))


def list_array(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))

"""MinHash signatures of word shingles for all documents of an Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from featherline.llm.arrays import seeds, span_hashes, text_bytes, word_shingles, word_spans


def batch_shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts of a column, and where each text begins."""
    flat, at = text_bytes(column)
    begins, ends, first = word_spans(flat, at)
    return word_shingles(span_hashes(flat, begins, ends), first, width)


def minhash(hashes: np.ndarray, at: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """`count` least hashes of each row that has elements: an array of (count, rows with elements)."""
    out = np.empty((count, int((np.diff(at) > 0).sum())), np.uint64)
    starts = at[:-1][np.diff(at) > 0]
    if len(starts):
        product = np.empty(len(hashes), np.uint64)
        for j, factor in enumerate(seeds(count, seed)):
            np.multiply(hashes, factor, out=product)
            out[j] = np.minimum.reduceat(product, starts)
    return out

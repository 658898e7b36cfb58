"""Token files compressed by a grammar: Re-Pair over the identifiers of a shard.

A pair of neighbouring symbols that occurs often becomes a new symbol, until none occurs
often enough.  A round takes all pairs that are nearly as frequent as the most frequent
one, by sorting the pairs; where two of them overlap the earlier one stands.  No rule
crosses the end of a document.  The file keeps the rules, the length that each symbol
expands to, and where documents begin among symbols and identifiers, so that any range of
identifiers is decoded from the symbols that cover it alone.

A file is little-endian: MAGIC; unsigned 64-bit numbers of documents, identifiers, rules,
symbols and the first rule's symbol; then, as arrays, the documents' numbers (64 bits,
and a byte that is 0 where there is none), their first identifiers and first symbols (64
bits, one more than documents), the expansion length of each rule (64 bits), the left and
right symbols of the rules and the symbols (32 bits).
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"REPAIR01"
#: A pair becomes a rule if it occurs this often; a rule itself takes as much room as four symbols.
LEAST_COUNT = 8
#: A round takes the pairs that occur at least 1/SHARE as often as the most frequent one.
SHARE = 64
HEAD = struct.Struct("<8s5Q")


def _sorted_pairs(symbols: np.ndarray, places: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that begin at the places, ascending, as left symbol * 2**32 + right symbol, and their places."""
    one, half, wide, low = np.uint64(1), np.uint64(32), np.uint64(bound.bit_length()), np.uint64(len(symbols).bit_length())
    fits = 2 * wide + low <= 64
    # In place, for new memory takes about as long as the sorting.
    packed = symbols[places].astype(np.uint64)
    packed <<= wide if fits else half
    packed |= symbols[places + 1]
    if not fits:
        order = np.argsort(packed)
        return packed[order], places[order]
    # Sorting numbers is several times as fast as sorting their places.
    packed <<= low
    packed |= places.view(np.uint64)
    packed.sort()
    pairs = packed >> low
    right = pairs & ((one << wide) - one)
    pairs >>= wide
    pairs <<= half
    pairs |= right
    packed &= (one << low) - one
    return pairs, packed.view(np.int64)


def compress(ids: np.ndarray, ends: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (left and right symbol of each), symbols, and the documents' ends among the symbols.

    ids: identifiers below `first_rule`; ends: where each document ends, ascending.  An
    empty document has no symbols.
    """
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(ids), bool)  # no pair begins at the end of a document
    last[ends[ends > 0] - 1] = True
    # A pair never becomes more frequent: where a rare one begins, none is sought until a new symbol stands there.
    alive = np.flatnonzero(~last[:-1])
    rules: list[np.ndarray] = []
    count = 0
    while len(symbols) > 1:
        ordered, order = _sorted_pairs(symbols, alive, first_rule + count)
        at = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
        times = np.diff(np.r_[at, len(ordered)])
        top = int(times.max(initial=0))
        if top < LEAST_COUNT:
            break
        often = times >= max(LEAST_COUNT, top // SHARE)
        chosen = ordered[at[often]]
        # Where chosen pairs stand, in order of place, and which they are.
        rule = np.repeat(np.arange(len(chosen)), times[often])
        packed = np.sort(order[np.repeat(often, times)] << 32 | rule)
        places, rule = packed >> 32, packed & 0xFFFFFFFF
        # Of overlapping places every second one stands, from the first of a run on.
        nth = np.arange(len(places))
        begins = np.r_[True, np.diff(places) != 1]
        stands = (nth - np.maximum.accumulate(np.where(begins, nth, 0))) & 1 == 0
        places, rule = places[stands], rule[stands]
        used = np.bincount(rule, minlength=len(chosen)) > 0
        new = first_rule + count - 1 + np.cumsum(used)
        rules.append(chosen[used])
        symbols[places] = new[rule]
        last[places] = last[places + 1]
        stays = np.ones(len(symbols), bool)
        stays[places + 1] = False
        # Where pairs may still be frequent: those that were, and on both sides of a new symbol.
        sought = np.zeros(len(symbols), bool)
        sought[order[np.repeat(times >= LEAST_COUNT, times)]] = True
        kept = np.flatnonzero(stays)
        symbols, last, sought = symbols[kept], last[kept], sought[kept]
        made = places - np.arange(len(places))
        sought[made] = True
        sought[np.maximum(made, 1) - 1] = True
        alive = np.flatnonzero(sought[:-1] & ~last[:-1])
        count += int(used.sum())
    made = np.concatenate(rules) if rules else np.zeros(0, np.uint64)
    sides = np.stack([made >> np.uint64(32), made & np.uint64(0xFFFFFFFF)]).astype(np.uint32)
    full = np.flatnonzero(last) + 1
    filled = np.diff(np.r_[0, ends]) > 0
    return sides, symbols, np.r_[0, full][np.cumsum(filled)]


def expansions(sides: np.ndarray, first_rule: int) -> np.ndarray:
    """How many identifiers each rule stands for.  A rule uses symbols made before it."""
    lengths = [1] * sides.shape[1]
    for k, (a, b) in enumerate(zip(sides[0].tolist(), sides[1].tolist())):
        lengths[k] = (1 if a < first_rule else lengths[a - first_rule]) + (1 if b < first_rule else lengths[b - first_rule])
    return np.array(lengths, np.uint64)


def pack(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray, first_rule: int) -> bytes:
    """A whole file."""
    ends = np.asarray(ends, np.int64)
    sides, symbols, symbol_ends = compress(ids, ends, first_rule)
    lengths = expansions(sides, first_rule)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    parts = [
        HEAD.pack(MAGIC, len(doc_ids), len(ids), sides.shape[1], len(symbols), first_rule),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        known.tobytes(),
        np.r_[0, ends].astype("<u8").tobytes(),
        np.r_[0, symbol_ends].astype("<u8").tobytes(),
        lengths.astype("<u8").tobytes(),
        sides.astype("<u4").tobytes(),
        symbols.astype("<u4").tobytes(),
    ]
    return b"".join(parts)


def n_identifiers(head: bytes) -> int:
    """From the first HEAD.size bytes of a file."""
    magic, _, tokens, *_ = HEAD.unpack(head[: HEAD.size])
    if magic != MAGIC:
        raise ValueError("not a token file")
    return tokens


class TokenFile:
    """The contents of one file; any part of it is decoded by itself."""

    def __init__(self, data: bytes) -> None:
        n_identifiers(data)
        _, documents, self.n_tokens, rules, symbols, self.first_rule = HEAD.unpack_from(data)
        at = HEAD.size

        def read(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        numbers, known = read("<i8", documents), read("u1", documents)
        self.doc_ids = [x if k else None for x, k in zip(numbers.tolist(), known.tolist())]
        self.starts = read("<u8", documents + 1).astype(np.int64)
        self.symbol_starts = read("<u8", documents + 1).astype(np.int64)
        self.lengths = read("<u8", rules).astype(np.int64)
        self.left, self.right, self.symbols = read("<u4", rules), read("<u4", rules), read("<u4", symbols)
        if at != len(data) or (len(self.starts) and self.starts[-1] != self.n_tokens):
            raise ValueError("a token file of another length than its head says")

    def _lengths(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        made = symbols >= self.first_rule
        out[made] = self.lengths[symbols[made] - self.first_rule]
        return out

    def expand(self, symbols: np.ndarray, first: int, count: int) -> np.ndarray:
        """Identifiers `first` to `first + count` of what the symbols stand for."""
        out = np.zeros(count, np.uint32)
        size = self._lengths(symbols)
        place = np.cumsum(size) - size - first
        while len(symbols):
            covers = (place < count) & (place + size > 0)
            if not covers.all():
                symbols, place = symbols[covers], place[covers]
            made = symbols >= self.first_rule
            out[place[~made]] = symbols[~made]
            rule, place = symbols[made] - self.first_rule, place[made]
            left, right = self.left[rule], self.right[rule]
            symbols = np.concatenate([left, right])
            size = self._lengths(symbols)
            place = np.concatenate([place, place + size[: len(left)]])
        return out

    def document(self, k: int) -> np.ndarray:
        """The identifiers of one document."""
        symbols = self.symbols[self.symbol_starts[k] : self.symbol_starts[k + 1]]
        return self.expand(symbols, 0, int(self.starts[k + 1] - self.starts[k]))

    def tokens(self, first: int, count: int) -> np.ndarray:
        """Any range of identifiers of the file, from the documents that it touches."""
        count = max(0, min(count, self.n_tokens - first))
        if count == 0:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self.starts, first, "right")) - 1
        b = int(np.searchsorted(self.starts, first + count, "left"))
        return self.expand(self.symbols[self.symbol_starts[a] : self.symbol_starts[b]], first - int(self.starts[a]), count)

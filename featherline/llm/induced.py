"""External induced sorting of suffixes with their common prefixes.

The text of a shard is a row of symbols; 0 ends each string, and of two ends the
earlier one counts as smaller, so no suffix reaches over an end.  Leftmost-smaller
suffixes are sorted by naming the pieces between them and sorting the shorter text of
names in the same way, until it fits into memory.  All others are induced: suffixes
leave a priority queue by first symbol and arrival, and each puts the suffix one
symbol longer back, with the length of the prefix that it shares with the suffix
queued before it.  Queues and sorted runs beyond the memory given go to unnamed files
of the task, as spilled rows do.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np

BATCH = 1 << 18


class Pool:
    """Holds pairs of arrays (positions, common prefixes): in memory up to a limit, then in a file."""

    def __init__(self, limit: int) -> None:
        self.limit, self.used, self.file = limit, 0, None

    def put(self, at: np.ndarray, lcp: np.ndarray) -> tuple:
        size = 9 * len(at)
        if self.used + size <= self.limit:
            self.used += size
            return at, lcp
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="suffixes-")
        offset = self.file.seek(0, 2)
        self.file.write(at.astype(np.int64).tobytes())
        self.file.write(lcp.astype(np.uint8).tobytes())
        return offset, len(at)

    def get(self, part: tuple, last: bool = True) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(part[0], np.ndarray):
            if last:
                self.used -= 9 * len(part[0])
            return part
        offset, count = part
        self.file.seek(offset)
        at = np.frombuffer(self.file.read(8 * count), np.int64)
        return at, np.frombuffer(self.file.read(count), np.uint8)

    def array(self, size: int, dtype: type) -> np.ndarray:
        if size * np.dtype(dtype).itemsize <= self.limit or not size:
            return np.empty(size, dtype)
        return np.memmap(tempfile.TemporaryFile(prefix="suffixes-"), dtype, "w+", shape=(size,))


class Queue:
    """Buckets of suffixes by first symbol; each gives back its suffixes in the order they came."""

    def __init__(self, pool: Pool, descending: bool) -> None:
        self.pool, self.sign = pool, -1 if descending else 1
        self.parts: dict[int, list[tuple]] = {}
        self.heap: list[int] = []

    def announce(self, symbol: int) -> None:
        if symbol not in self.parts:
            self.parts[symbol] = []
            heapq.heappush(self.heap, self.sign * symbol)

    def push(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.announce(symbol)
        self.parts[symbol].append(self.pool.put(at, lcp))

    def symbols(self) -> Iterator[int]:
        while self.heap:
            symbol = self.sign * heapq.heappop(self.heap)
            yield symbol
            self.parts.pop(symbol)

    def drain(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while self.parts[symbol]:
            waiting, self.parts[symbol] = self.parts[symbol], []
            small: list[tuple[np.ndarray, np.ndarray]] = []
            for part in waiting:
                small.append(self.pool.get(part))
                if sum(len(x) for x, _ in small) >= BATCH:
                    yield _joined(small)
                    small = []
            if small:
                yield _joined(small)


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return (parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts)))


class Shared:
    """Common prefixes of suffixes queued one after another, from those of the suffixes scanned between them."""

    def __init__(self, cap: int) -> None:
        self.cap, self.count = cap, 0
        self.places: list[int] = []  # of scanned suffixes whose value is below all later ones
        self.values: list[int] = []
        self.last: dict[int, int] = {}

    def since(self, place: int) -> int:
        k = int(np.searchsorted(self.places, place, "right"))
        return self.values[k] if k < len(self.values) else 255

    def queued(self, lcp: np.ndarray, nth: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order by symbol of the queued suffixes `nth` of a batch, their prefixes, and where each symbol begins."""
        order = np.argsort(symbols, kind="stable")
        nth, symbols = nth[order], symbols[order]
        begins = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1])) if len(nth) else np.zeros(0, np.int64)
        low = np.zeros(len(nth), np.int64)
        low[1:] = nth[:-1] + 1
        low[begins] = 0
        levels = [lcp.astype(np.uint8)]
        while (2 << len(levels)) <= 2 * len(lcp):
            step = 1 << (len(levels) - 1)
            level = levels[-1].copy()
            np.minimum(level[:-step], levels[-1][step:], out=level[:-step])
            levels.append(level)
        table = np.stack(levels)
        width = np.frexp((nth - low + 1).astype(np.float64))[1] - 1
        shared = np.minimum(table[width, low], table[width, nth - (1 << width.astype(np.int64)) + 1]).astype(np.int64) if len(nth) else low
        shared += 1
        ends = np.append(begins[1:], len(nth))
        for b, e in zip(begins.tolist(), ends.tolist()):
            symbol = int(symbols[b])
            before = self.last.get(symbol)
            shared[b] = 0 if before is None else min(int(shared[b]), self.since(before) + 1)
            self.last[symbol] = self.count + int(nth[e - 1])
        lowest = np.minimum.accumulate(lcp[::-1])[::-1]
        keep = np.flatnonzero(np.append(lowest[:-1] < lowest[1:], True))
        while self.values and self.values[-1] >= int(lowest[0]):
            self.values.pop()
            self.places.pop()
        self.places += (keep + self.count).tolist()
        self.values += lcp[keep].tolist()
        self.count += len(lcp)
        return order, np.minimum(shared, self.cap).astype(np.uint8), begins


def agree(text: np.ndarray, a: np.ndarray, b: np.ndarray, have: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of suffixes that agree in `have` symbols at least, up to `cap`."""
    have = np.minimum(have, cap).astype(np.int64)
    todo = np.flatnonzero(have < cap)
    while len(todo):
        x = text[a[todo] + have[todo]]
        todo = todo[(x == text[b[todo] + have[todo]]) & (x != 0)]
        have[todo] += 1
        todo = todo[have[todo] < cap]
    return have


def smaller_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last symbol counts as smaller."""
    n = len(text)
    differs = np.append(text[1:] != text[:-1], True)
    less = np.append(text[:-1] < text[1:], True)
    places = np.where(differs, np.arange(n), n)
    following = np.minimum.accumulate(places[::-1])[::-1]
    return less[following]


def piece_names(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Order-preserving names from 1 of the pieces from each position to the next one; 0 for ends of strings."""
    bits = 16 if len(text) == 0 or int(text.max()) < 0xFFFF else 32
    per = 64 // bits
    lengths = np.append(np.diff(at), 0) + 1
    names = np.zeros(len(at), np.int64)
    tied = np.flatnonzero(text[at] != 0)
    rank, step = np.zeros(len(tied), np.int64), 0
    while len(tied):
        key = np.zeros(len(tied), np.uint64)
        for j in range(step, step + per):
            symbol = np.full(len(tied), (1 << bits) - 1, np.uint64)  # a piece comes after those it begins
            inside = lengths[tied] > j
            symbol[inside] = text[at[tied[inside]] + j]
            key = (key << np.uint64(bits)) | symbol
        order = np.lexsort((key, rank))
        rank, key, tied = rank[order], key[order], tied[order]
        group = np.append(True, rank[1:] != rank[:-1])
        part = group | np.append(True, key[1:] != key[:-1])
        place = np.arange(len(tied))
        first = np.maximum.accumulate(np.where(group, place, 0))
        rank = rank + np.maximum.accumulate(np.where(part, place, 0)) - first
        names[tied] = rank + 1
        step += per
        sizes = np.diff(np.append(np.flatnonzero(part), len(tied)))
        more = (np.repeat(sizes, sizes) > 1) & (lengths[tied] > step)
        # all of a tied part go on together, so that shorter pieces keep their place in it
        flag = np.add.reduceat(more, np.flatnonzero(part)) > 0
        stay = np.repeat(flag, sizes)
        tied, rank = tied[stay], rank[stay]
    return names


def _sorted_by(rank: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by rank, then second (from -1 on), and where one of them differs from that of the one before."""
    n = len(rank)
    low, mid, high = n.bit_length(), (int(second.max(initial=0)) + 1).bit_length(), int(rank.max(initial=0)).bit_length()
    if low + mid + high < 64:  # sorting numbers is several times as fast as sorting their places
        packed = np.sort((rank << mid | (second + 1)) << low | np.arange(n))
        order, key = packed & ((1 << low) - 1), packed >> low
        return order, np.append(False, key[1:] != key[:-1])
    order = np.lexsort((second, rank))
    rank, second = rank[order], second[order]
    return order, np.append(False, (rank[1:] != rank[:-1]) | (second[1:] != second[:-1]))


def sort_in_memory(text: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes that are not ends, and common prefixes, by doubling."""
    ends = text == 0
    count = int(ends.sum())
    rank = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + count)
    ranks, width, n = [rank], 1, len(text)
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - width] = rank[width:] if width < n else 0
        order, new = _sorted_by(rank, second)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if int(rank.max(initial=0)) == n - 1 or width >= n:
            break
        ranks.append(rank)
        width *= 2
    order = order[text[order] != 0]
    lcp = np.zeros(len(order), np.int64)
    a, b = order[1:].copy(), order[:-1].copy()
    for j in range(len(ranks) - 1, -1, -1):
        same = (np.maximum(a, b) < n) & (ranks[j][np.minimum(a, n - 1)] == ranks[j][np.minimum(b, n - 1)])
        a[same] += 1 << j
        b[same] += 1 << j
    lcp[1:] = a - order[1:]
    return order, np.minimum(lcp, cap).astype(np.uint8)


def suffix_order(text: np.ndarray, cap: int, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes that are not ends of strings, in order, and the prefix shared with the one before, up to `cap`.

    text: non-negative symbols, 0 last and nowhere twice in a row; cap: below 255.
    memory: bytes for queues and runs in memory; larger ones are files.
    """
    if len(text) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    pool = Pool(memory)
    smaller = smaller_types(text)
    seeds = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    del smaller
    names = piece_names(text, seeds)
    if 64 * len(names) <= memory or len(names) < 64:
        order, lcp = sort_in_memory(names, cap)
    else:
        order, lcp = suffix_order(names, cap, memory)
    at = seeds[order]
    have = np.zeros(len(order), np.int64)
    if len(order):
        have[1:] = seeds[np.minimum(order[1:] + lcp[1:], len(seeds) - 1)] - at[1:]
        have[1:] = agree(text, at[1:], at[:-1], have[1:], cap)
    ends = np.flatnonzero(text == 0)
    seeds, seed_lcp = np.concatenate([ends, at]), np.concatenate([np.zeros(len(ends), np.uint8), have.astype(np.uint8)])
    symbols = text[seeds]
    begins = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
    seeds_of = {int(symbols[b]): (b, e) for b, e in zip(begins.tolist(), [*begins[1:].tolist(), len(seeds)])}

    def scan(queue: Queue, shared: Shared, batch: tuple, symbol: int, strictly: bool) -> None:
        positions, lcp = batch
        for first in range(0, len(positions), BATCH):
            p, c = positions[first : first + BATCH], lcp[first : first + BATCH]
            before = text[np.maximum(p - 1, 0)]
            if queue.sign > 0:
                good = (p > 0) & (before >= symbol)
            else:
                good = (p > 0) & (before != 0) & ((before < symbol) if strictly else (before <= symbol))
            nth = np.flatnonzero(good)
            order, prefix, starts = shared.queued(c, nth, before[nth])
            longer, to = (p[nth] - 1)[order], before[nth][order]
            for b, e in zip(starts.tolist(), [*starts[1:].tolist(), len(longer)]):
                queue.push(int(to[b]), longer[b:e], prefix[b:e])

    def boundary(a: int, b: int) -> int:
        return int(agree(text, np.array([a]), np.array([b]), np.zeros(1), cap)[0])

    larger: dict[int, list[tuple]] = {}
    queue, shared = Queue(pool, False), Shared(cap)
    for symbol in seeds_of:
        queue.announce(symbol)
    for symbol in queue.symbols():
        runs, last = [], -1
        for batch in queue.drain(symbol):
            runs.append(pool.put(*batch))
            last = int(batch[0][-1])
            scan(queue, shared, batch, symbol, False)
        if runs:
            larger[symbol] = runs
        if symbol in seeds_of:
            b, e = seeds_of[symbol]
            prefix = seed_lcp[b:e].copy()
            prefix[0] = boundary(last, int(seeds[b])) if last >= 0 and symbol else 0
            scan(queue, shared, (seeds[b:e], prefix), symbol, True)

    smaller_runs: dict[int, tuple[list[tuple], int]] = {}
    queue, shared = Queue(pool, True), Shared(cap)
    for symbol in larger:
        queue.announce(symbol)
    for symbol in queue.symbols():
        runs, last, link = [], -1, 0
        for batch in queue.drain(symbol):
            runs.append(pool.put(*batch))
            last = int(batch[0][-1])
            scan(queue, shared, batch, symbol, False)
        following = 0  # the prefix shared with the suffix scanned before
        for k, part in enumerate(reversed(larger.get(symbol, []))):
            positions, lcp = pool.get(part, last=False)
            if k == 0 and last >= 0:
                following = link = boundary(last, int(positions[-1]))
            prefix = np.append(lcp[1:], following).astype(np.uint8)[::-1]
            following = int(lcp[0])
            scan(queue, shared, (positions[::-1], prefix), symbol, True)
        if runs:
            smaller_runs[symbol] = runs, link

    size = int((text != 0).sum())
    out, out_lcp, done = pool.array(size, np.int64), pool.array(size, np.uint8), 0
    for symbol in sorted({*larger, *smaller_runs}):
        for part in larger.get(symbol, []):
            positions, lcp = pool.get(part)
            out[done : done + len(positions)], out_lcp[done : done + len(positions)] = positions, lcp
            done += len(positions)
        runs, following = smaller_runs.get(symbol, ([], 0))
        for part in reversed(runs):
            positions, lcp = pool.get(part)
            out[done : done + len(positions)] = positions[::-1]
            out_lcp[done] = following
            out_lcp[done + 1 : done + len(positions)] = lcp[:0:-1]
            following = lcp[0]
            done += len(positions)
    return out[:done], out_lcp[:done]

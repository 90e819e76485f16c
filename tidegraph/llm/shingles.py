"""Word and shingle hashes of whole batches of texts, computed over their UTF-8 bytes in one go.

A word's hash is a polynomial of its bytes modulo 2**64, read off a running sum,
then mixed; so no Python object is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
WIDTH = 5
CHUNK_BYTES = 1 << 21

BASE = 0x9E3779B97F4A7C15 | 1
_UNDO = pow(BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(29))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(32))


_LETTER = mix(np.arange(1, 257, dtype=U))
_powers = {BASE: np.ones(1, U), _UNDO: np.ones(1, U)}


def powers(base: int, n: int) -> np.ndarray:
    known = _powers[base]
    if len(known) < n:
        size = max(n, CHUNK_BYTES + 1)
        grown = np.empty(size, U)
        grown[0], have = 1, 1
        while have < size:
            step = min(have, size - have)
            grown[have : have + step] = grown[:step] * U(pow(base, have, 1 << 64))
            have += step
        _powers[base] = known = grown
    return known[:n]


def text_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, null as empty, and where each text begins (and the last ends)."""
    texts = pc.fill_null(column.combine_chunks().cast(pa.large_string()), "")
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> list[tuple[int, int]]:
    """Runs of texts of about `limit` bytes; a longer text is a run of its own."""
    runs, first = [], 0
    for k in range(1, len(offsets)):
        if offsets[k] - offsets[first] > limit and k - 1 > first:
            runs.append((first, k - 1))
            first = k - 1
    if len(offsets) - 1 > first:
        runs.append((first, len(offsets) - 1))
    return runs


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (run of bytes that are no breaks, inside one text), and the first word of each text."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~breaks[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans from running sums of values times `BASE` to the power of their place."""
    return mix((sums[ends] - sums[starts]) * powers(_UNDO, len(sums))[starts])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, A-Z in lower case, and the first word of each text.

    A word's hash sums a random value per byte and place in the word.  Unlike a polynomial modulo
    a power of two, that has no words built to collide.
    """
    data = _LOWER[data]
    starts, ends, first = word_spans(data, offsets, SPACES)
    begun = np.zeros(len(data), np.int64)
    begun[starts] = starts
    place = (np.arange(len(data)) - np.maximum.accumulate(begun)).astype(U)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(mix(_LETTER[data] + place * U(0x9E3779B97F4A7C15)), out=sums[1:])
    return mix(sums[ends] - sums[starts]), first


def shingle_sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The sorted distinct shingles of each text: of `WIDTH` words, or the whole sequence if it is shorter."""
    data, offsets = text_bytes(column)
    sets: list[np.ndarray] = []
    step = U(0xD6E8FEB86659FD93)
    for a, b in chunks(offsets):
        hashes, first = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        long = hashes[: max(0, len(hashes) - WIDTH + 1)].copy()
        for k in range(1, WIDTH):
            long = long * step + hashes[k : k + len(long)]
        long = mix(long + U(WIDTH))
        for i, j in zip(first[:-1], first[1:], strict=True):
            n = j - i
            if n >= WIDTH:
                own = np.sort(long[i : j - WIDTH + 1])
                sets.append(own[np.append(True, own[1:] != own[:-1])])
            elif n:
                own = hashes[i : i + 1]
                for k in range(1, n):
                    own = own * step + hashes[i + k : i + k + 1]
                sets.append(mix(own + U(n)))
            else:
                sets.append(np.zeros(0, U))
    return sets


class Table:
    """Rows of known hashes by open addressing."""

    def __init__(self, hashes: np.ndarray) -> None:
        bits = max(8, int(np.ceil(np.log2(max(1, len(hashes)) * 4))))
        self.mask = U((1 << bits) - 1)
        self.keys, self.rows = np.zeros(1 << bits, U), np.full(1 << bits, -1, np.int32)
        waiting, at = np.arange(len(hashes)), hashes & self.mask
        while len(waiting):
            free = self.rows[at] < 0
            slots, winners = np.unique(at[free], return_index=True)
            placed = waiting[free][winners]
            self.keys[slots], self.rows[slots] = hashes[placed], placed
            left = np.isin(waiting, placed, invert=True)
            waiting, at = waiting[left], (at[left] + U(1)) & self.mask

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        at = hashes & self.mask
        found = self.rows[at]
        unsure = np.flatnonzero((found >= 0) & (self.keys[at] != hashes))
        while len(unsure):
            at[unsure] = (at[unsure] + U(1)) & self.mask
            found[unsure] = self.rows[at[unsure]]
            unsure = unsure[(found[unsure] >= 0) & (self.keys[at[unsure]] != hashes[unsure])]
        return found

"""Vectorised tokenisation of Arrow text columns.

A batch of texts is one byte buffer with offsets.  Words are found with byte
masks, and a word's 64-bit hash comes from prefix sums of a polynomial hash
modulo 2**64, so no Python object is made for a word.  Both word definitions
used here treat every byte from 0x80 as part of a word, so bytes and code
points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken together until they hold so many bytes; one longer text is taken alone.
CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes of ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in lower-cased text.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Texts:
    """Some whole texts: bytes, and the offsets at which texts start and end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: slice):
        self.data, self.offsets, self.rows = data, offsets, rows

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lowered(self) -> Texts:
        return Texts(LOWER[self.data], self.offsets, self.rows)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The whole texts of an Arrow string column, in order; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        yield Texts(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], slice(first, last))
        first = last


def word_spans(t: Texts, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    mask = table[t.data]
    if not len(mask):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(t) + 1, np.int64)
    inner = t.offsets[:-1][t.offsets[:-1] < len(mask)]
    before = np.empty_like(mask)
    before[0], before[1:] = False, mask[:-1]
    before[inner] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty_like(mask)
    after[-1], after[:-1] = False, mask[1:]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, t.offsets)


class Hasher:
    """Hashes of any byte ranges of one chunk."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = _power_tables(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        terms = _BYTE[data]
        terms *= up[:n]
        np.cumsum(terms, out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.sums[ends] - self.sums[starts]
        h *= self.down[starts]
        h += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix(h)


def word_hashes(t: Texts, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts in lower case, and for each text the index of its first word (one more at the end).

    A long text is hashed piece by piece, cut where no word is, so that what is
    held beside the hashes depends on a piece and on the longest word only.
    """
    if len(t.data) <= 2 * CHUNK_BYTES:
        starts, ends, first = word_spans(t, table)
        return (Hasher(t.data)(starts, ends) if len(starts) else np.zeros(0, np.uint64)), first
    out, sizes = [], np.zeros(len(t) + 1, np.int64)
    for i in range(len(t)):
        lo, end = int(t.offsets[i]), int(t.offsets[i + 1])
        while lo < end:
            hi = min(lo + CHUNK_BYTES, end)
            while hi < end:  # on to the next byte that is in no word
                ahead = min(hi + CHUNK_BYTES, end)
                gap = np.flatnonzero(~table[t.data[hi:ahead]])
                if len(gap):
                    hi += int(gap[0])
                    break
                hi = ahead
            piece = Texts(t.data[lo:hi], np.array([0, hi - lo]), slice(0, 1))
            starts, ends, _ = word_spans(piece, table)
            if len(starts):
                out.append(Hasher(piece.data)(starts, ends))
                sizes[i + 1] += len(starts)
            lo = hi
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(sizes)


def hash_of(text: bytes) -> int:
    """The hash that ``Hasher`` gives to these bytes."""
    data = np.frombuffer(text, dtype=np.uint8)
    return int(Hasher(data)(np.zeros(1, np.int64), np.array([len(data)]))[0])


class Lookup:
    """Position of a hash in a sorted table, -1 where it is absent; the first bits of a hash tell where in the table to look."""

    def __init__(self, hashes: np.ndarray, bits: int = 20):
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = np.asarray(hashes, dtype=np.uint64)[self.order]
        self.shift = np.uint64(64 - bits)
        held = np.bincount((self.sorted >> self.shift).astype(np.int64), minlength=1 << bits)
        self.begin = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, dtype=np.int64)
        if not len(self.sorted):
            return out
        slot = (h >> self.shift).astype(np.int64)
        k, end, at = self.begin[slot], self.begin[slot + 1], np.arange(len(h))
        while len(at):
            # The others have either been found or come to the end of their slot.
            at, k, end = (x[k < end] for x in (at, k, end))
            there = self.sorted[k]
            hit = there == h[at]
            out[at[hit]] = self.order[k[hit]]
            more = there < h[at]
            at, k, end = at[more], k[more] + 1, end[more]
        return out

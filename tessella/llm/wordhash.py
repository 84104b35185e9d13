"""Words of Arrow text columns as flat NumPy arrays.

A word is a run of bytes other than space and 9 to 13; in UTF-8 these bytes never occur inside another
character. Words get 64-bit hashes from prefix sums of byte terms, so no word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; a single longer text is handled alone.
CHUNK_BYTES = 1 << 21

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20260101)
_TERM = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_TERM_2 = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_STEP = 0xD6E8FEB86659FD93 | 3
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; each input bit reaches each output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.ones(1, dtype=np.uint64)
                while len(x) < size:
                    x = np.concatenate([x, x * U64(pow(b, len(x), 1 << 64))])
                setattr(self, name, x)
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(_BASE), _Powers(_STEP)


@dataclass
class Words:
    """Words of several texts: byte ranges in data, a hash each; text d has words first[d]:first[d+1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    text_from: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash and text of each run of n words inside one text, and the run's first word."""
        w = len(self.hash)
        if w < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        up, down = _WORD_POWERS.upto(w + 1)
        sums = np.zeros(w + 1, dtype=np.uint64)
        np.cumsum(self.hash * up[:w], out=sums[1:])
        h = (sums[n:] - sums[:-n]) * down[: w - n + 1]
        doc = self.doc
        at = np.flatnonzero(doc[: w - n + 1] == doc[n - 1 :])
        return mix(h[at] + U64(n)), doc[at], at


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes."""
    if len(column) == 0:
        return
    offsets = _offsets(column)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, to
        at = to


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1]


def plain(column) -> pa.Array:
    """One string array without nulls; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    return column


def _spans(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Bytes of a string array without nulls, bounds of its texts in them, first and last bytes of words."""
    off = _offsets(column).astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    inside = ~_BREAK[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return data, off, start, end


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False, second: bool = False) -> np.ndarray:
    """A hash of each byte range; `second` gives one that is independent of the first."""
    up, down = _BYTE_POWERS.upto(len(data) + 1)
    terms = _TERM_2 if second else _TERM
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((terms[_LOWER] if lower else terms)[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def words_of(column: pa.Array, lower: bool = False) -> Words:
    """The words of a (slice of a) string array without nulls."""
    if len(column) == 0 or column.buffers()[1] is None:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), z, z, np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64), np.zeros(len(column) + 1, np.int64))
    data, off, start, end = _spans(column)
    return Words(data, start, end, hash_spans(data, start, end, lower), np.searchsorted(start, off), off)


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of n words by text: hashes, sorted within each text, and bounds. A text of fewer
    words has its whole sequence as one shingle; without words it has none."""
    h, doc, _ = words.ngrams(n)
    count = words.counts
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = []
        for d in short:
            x = words.hash[words.first[d] : words.first[d + 1]]
            up, _ = _WORD_POWERS.upto(n + 1)
            extra.append(mix(np.array([np.sum(x * up[: len(x)], dtype=np.uint64) + U64(len(x))], dtype=np.uint64))[0])
        h, doc = np.concatenate([h, np.array(extra, dtype=np.uint64)]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(count) + 1))


class HashIndex:
    """Places of distinct 64-bit keys, found in an open hash table of NumPy arrays."""

    def __init__(self, keys: np.ndarray):
        self.slots = 1 << max(4, (3 * len(keys)).bit_length())
        self.key, self.at = np.zeros(self.slots, dtype=np.uint64), np.full(self.slots, -1, dtype=np.int32)
        slot, open_ = (keys & U64(self.slots - 1)).astype(np.int64), np.arange(len(keys))
        while len(open_):
            free = open_[self.at[slot[open_]] < 0]
            self.at[slot[free]] = free
            won = free[self.at[slot[free]] == free]
            self.key[slot[won]] = keys[won]
            open_ = np.setdiff1d(open_, won, assume_unique=True)
            slot[open_] = (slot[open_] + 1) & (self.slots - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for those that aren't there."""
        slot = (keys & U64(self.slots - 1)).astype(np.int64)
        out = self.at[slot].astype(np.int64)
        open_ = np.flatnonzero((out >= 0) & (self.key[slot] != keys))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (self.slots - 1)
            at = slot[open_]
            out[open_] = self.at[at]
            open_ = open_[(out[open_] >= 0) & (self.key[at] != keys[open_])]
        return out

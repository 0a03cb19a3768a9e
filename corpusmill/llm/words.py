"""Words of whole Arrow text columns as numpy arrays: no Python object per word.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Texts are UTF-8, and none of
those bytes occurs inside a longer UTF-8 sequence, so splitting bytes splits characters.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A column is worked on in pieces of about this many bytes, which bounds a worker's memory.
PIECE = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words once punctuation is left out: letters, digits and all of non-ASCII.
BARE = np.ones(256, bool)
BARE[48:58] = BARE[65:91] = BARE[97:123] = False
BARE[128:] = False

_R = 0x9E3779B97F4A7C15
_RI = pow(_R, -1, 1 << 64)
_K = 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The first powers of ``base``; up to half a million are kept."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, np.uint64)
        got[0] = 1
        got = np.cumprod(got, dtype=np.uint64)
        if n <= 1 << 19:
            _powers[base] = got
    return got[:n]


def tidy(run):
    """``run`` over batches, after which free memory goes back to the system.

    Workers stay for later tasks of other stages, and what they hold counts there.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (the SplitMix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(values: np.ndarray, base: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Polynomial hash, modulo 2^64, of ``values[first:last]`` for each pair of bounds."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _power(base, n), out=total[1:])
    return (total[last] - total[first]) * _power(pow(base, -1, 1 << 64), n + 1)[first]


def column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary array; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if not len(array) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def pieces(batch: pa.RecordBatch, name: str, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``size`` bytes of text each; one long row makes a slice of its own."""
    if not batch.num_rows:
        return
    _, off = column(batch.column(name))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Spans of words: ``starts``/``ends`` in ``data``; row r has the words ``first[r]:first[r + 1]``."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False, bare: bool = False):
        self.data = data = LOWER[data] if lower else data
        gap = (BARE if bare else SPACE)[data]
        inside = ~gap
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= gap[:-1]
        ends[:-1] &= gap[1:]
        edge = off[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        starts[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, off)

    @classmethod
    def of(cls, array: pa.Array, **how) -> Words:
        return cls(*column(array), **how)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def spaced(self) -> Words:
        """The same words with exactly one space after each, so that a run of words is one slice."""
        wide = self.ends - self.starts + 1
        to = np.cumsum(wide)
        out = object.__new__(Words)
        out.first, out.ends, out.starts = self.first, to - 1, to - wide
        at = np.arange(to[-1] if len(to) else 0) - np.repeat(out.starts - self.starts, wide)
        out.data = np.append(self.data, np.uint8(32))[at]
        out.data[out.ends] = 32
        return out

    def hashes(self) -> np.ndarray:
        """A 64-bit number for each word, equal for equal words."""
        return mix(rolling(self.data.astype(np.uint64) + np.uint64(1), _R, self.starts, self.ends))

    def last(self) -> np.ndarray:
        """For each word, the end of its row's words."""
        return np.repeat(self.first[1:], self.counts)

    def numbers(self) -> np.ndarray:
        """A number from 0 for each word, the same for equal words only: hashes group them, bytes are compared."""
        h = self.hashes()
        order = np.argsort(h, kind="stable")
        new = np.append(True, h[order[1:]] != h[order[:-1]])[: len(h)]
        if not same(self, order[1:][~new[1:]], self, order[:-1][~new[1:]]).all():  # two words of one hash
            seen: dict[bytes, int] = {}
            return np.array([seen.setdefault(self.data[a:b].tobytes(), len(seen)) for a, b in zip(self.starts, self.ends, strict=True)], np.int64)
        out = np.empty(len(h), np.int64)
        out[order] = np.cumsum(new) - 1
        return out


def same(a: Words, i: np.ndarray, b: Words, k: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Whether word i[n] of ``a`` and word k[n] of ``b`` have the same bytes."""
    wide = a.ends[i] - a.starts[i]
    out = wide == b.ends[k] - b.starts[k]
    for at in range(0, len(i), step):
        live = at + np.flatnonzero(out[at : at + step])
        if not len(live):
            continue
        w = wide[live]
        first = np.cumsum(w) - w
        inside = np.arange(w.sum()) - np.repeat(first, w)
        equal = a.data[np.repeat(a.starts[i[live]], w) + inside] == b.data[np.repeat(b.starts[k[live]], w) + inside]
        out[live] = np.logical_and.reduceat(equal, first)
    return out


def windows(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all runs of ``size`` words inside a row, and a 64-bit hash of each run."""
    at = np.arange(len(words))
    at = at[at + size <= words.last()]
    return at, mix(rolling(hashes, _K, at, at + size))

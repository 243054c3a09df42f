"""Vectorised work on the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64


_kept: list[dict] = []


def keep_only(own: dict | None) -> None:
    """A worker serves one operator after another: before one fills its cache, the others' caches are emptied."""
    if own is not None and not any(c is own for c in _kept):
        _kept.append(own)
    for cache in _kept:
        if cache is not own:
            cache.clear()


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks, and what they hold counts against executors."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = 0x9E3779B97F4A7C15
_UNSTEP = pow(_STEP, -1, 1 << 64)
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64."""
    if base not in _powers or len(_powers[base]) <= n:
        out = np.full(max(n, 1 << 20) + 1, base, dtype=U64)
        out[0] = 1
        _powers[base] = np.cumprod(out, dtype=U64)
    return _powers[base][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offset of each text (one more than texts); a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[at : at + n + 1] if n else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def batches(table: pa.RecordBatch, text: str, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about `most` bytes of text, or one longer text, each with its bytes and offsets."""
    if not table.num_rows:
        return
    data, offsets = text_buffers(table.column(text))
    first = 0
    while first < table.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield table.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def chunks(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts in runs of about `most` bytes, or of one longer text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Words:
    """The words of many texts: start and end byte, a 64-bit hash of the lower-cased word, and each text's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        blank = _BLANK[data]
        edge = np.zeros(n + 1, dtype=bool)  # a word ends before these bytes whatever comes
        edge[offsets] = True
        begins = ~blank
        ends = begins.copy()
        if n:
            begins[1:] &= blank[:-1] | edge[1:n]
            ends[:-1] &= blank[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        values = _BYTE_VALUES[_LOWER[data]]
        values *= _power(_STEP, n)[:n]
        total = np.zeros(n + 1, dtype=U64)
        np.cumsum(values, out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * _power(_UNSTEP, n)[self.start] + (self.end - self.start).astype(U64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


class HashIndex:
    """Places of 64-bit hashes, in order of arrival, in an open table that is probed for many hashes at once."""

    def __init__(self, slots: int = 1 << 21):
        self.keys, self.places, self.used = np.zeros(slots, dtype=U64), np.full(slots, -1, dtype=np.int64), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash; -1 where it has none."""
        mask = U64(len(self.keys) - 1)
        slot = (hashes & mask).astype(np.int64)
        out = self.places[slot]
        open_ = np.flatnonzero((self.keys[slot] != hashes) & (out >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(mask)
            at = slot[open_]
            out[open_] = self.places[at]
            open_ = open_[(self.keys[at] != hashes[open_]) & (out[open_] >= 0)]
        return out

    def add(self, hashes: np.ndarray) -> np.ndarray:
        """Places for distinct hashes that have none; the table doubles before it is half full."""
        if 2 * (self.used + len(hashes)) > len(self.keys):
            old, places = self.keys[self.places >= 0], self.places[self.places >= 0]
            slots = len(self.keys)
            while 2 * (self.used + len(hashes)) > slots:
                slots *= 2
            self.keys, self.places = np.zeros(slots, dtype=U64), np.full(slots, -1, dtype=np.int64)
            self._put(old, places)
        out = np.arange(self.used, self.used + len(hashes))
        self._put(hashes, out)
        self.used += len(hashes)
        return out

    def _put(self, hashes: np.ndarray, places: np.ndarray) -> None:
        mask = len(self.keys) - 1
        slot, left = (hashes & U64(mask)).astype(np.int64), np.arange(len(hashes))
        while len(left):
            at = slot[left]
            free = self.places[at] < 0
            self.places[at[free]] = places[left[free]]  # of several in one slot the last stays
            done = self.places[at] == places[left]
            self.keys[at[done]] = hashes[left[done]]
            left = left[~done]
            slot[left] = (slot[left] + 1) & mask

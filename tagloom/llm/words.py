"""Vectorised word segmentation and hashing of Arrow string columns.

A *word* is a maximal run of ASCII letters and digits and of characters beyond ASCII,
after lower-casing; everything else separates words. All functions treat a null text
as an empty one, look at whole texts, and work on slices of bounded size: a slice
holds about ``SLICE_BYTES`` of text, or one text if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on an array of uint64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def mix_int(x: int) -> int:
    m = (1 << 64) - 1
    x = (x + 0x9E3779B97F4A7C15) & m
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    return x ^ (x >> 31)


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    have, step = 1, _U(base & (2**64 - 1))
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * step
        have += take
        step = step * step
    return out


class _Local(dict):
    """A cache that stays in its process: it travels to workers empty."""

    def __reduce__(self):
        return _Local, ()


_POW = _Local()


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("f", ())) < n:
        m = max(n, SLICE_BYTES + SLICE_BYTES // 4)
        with np.errstate(over="ignore"):
            _POW["f"] = powers(m, _BASE)
            _POW["i"] = powers(m, pow(_BASE, -1, 2**64))
    return _POW["f"], _POW["i"]


def word_bytes() -> np.ndarray:
    lut = np.zeros(256, dtype=bool)
    lut[48:58] = lut[65:91] = lut[97:123] = lut[128:] = True
    return lut


def buffer_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the n+1 offsets of its rows; nulls are empty."""
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(arr) else np.zeros(0, np.uint8)
    return raw, offsets - (offsets[0] if len(offsets) else 0)


class Words:
    """The words of a slice: doc index, hash, byte span in the lower-cased text, rows' first words."""

    __slots__ = ("doc", "hash", "start", "end", "first", "n_docs", "lowered", "_sums")

    def __init__(self, arr: pa.Array):
        if isinstance(arr, pa.ChunkedArray):
            arr = arr.combine_chunks()
        self.lowered = pc.utf8_lower(arr)
        raw, off = buffer_of(self.lowered)
        n, self.n_docs = len(raw), len(arr)
        inside = word_bytes()[raw]
        begin = np.zeros(n + 1, dtype=bool)
        begin[off[:-1]] = True
        prev = np.empty(n, dtype=bool)
        if n:
            prev[0] = False
            prev[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~prev | begin[:-1]))
        stop = np.zeros(n + 1, dtype=bool)
        stop[1:] = inside
        cut = np.ones(n + 1, dtype=bool)
        cut[:-1] = ~inside | begin[:-1]
        self.end = np.flatnonzero(stop & cut)
        fwd, inv = _tables(n + 1)
        with np.errstate(over="ignore"):
            pre = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(raw.astype(np.uint64) * fwd[:n], out=pre[1:])
        self._sums = pre, inv
        self.hash = self._hash(self.end)
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def _hash(self, end: np.ndarray) -> np.ndarray:
        pre, inv = self._sums
        with np.errstate(over="ignore"):
            return mix((pre[end] - pre[self.start]) * inv[self.start] + (end - self.start).astype(np.uint64))

    def beginnings(self, n: int) -> np.ndarray:
        """Hashes of the words' first n bytes."""
        return self._hash(np.minimum(self.start + n, self.end))


def shingle_hashes(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within one document, and the index of each run's first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        acc = h[:n].copy()
        for j in range(1, k):
            acc *= _U(0xD6E8FEB86659FD93)
            acc += h[j : n + j]
        acc = mix(acc)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return acc[at], at


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about ``limit`` bytes of text each."""
    col = batch.column(batch.schema.get_field_index(text))
    _, off = buffer_of(col)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)

"""Vectorised word splitting and hashing of Arrow text columns, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20  # text handled at once; a longer text is a chunk of its own

_rng = np.random.default_rng(20240611)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}

# Bytes that end a word: space and \t..\r, or everything but ASCII letters, digits and non-ASCII bytes.
SPACES = np.array([b in (32, 9, 10, 11, 12, 13) for b in range(256)])
NOT_ALNUM = np.array([b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


class Words:
    """Words of consecutive texts: ``start``/``end`` byte offsets into ``data``, ``hash`` per word and
    ``first`` where each text's words begin (one entry more than texts)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, ends_word: np.ndarray, lower: bool):
        self.data = data
        inside = ~ends_word[LOWER[data]] if lower else ~ends_word[data]
        before = np.empty_like(inside)
        if len(inside):
            before[0] = False
            before[1:] = inside[:-1]
        cuts = bounds[1:-1]
        cuts = cuts[cuts < len(inside)]
        before[cuts] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(inside) + 1, bool)
        after[:-1] = ~inside
        if len(inside):
            after[-1] = True
        after[cuts] = True  # a text that begins ends the word before
        stops = np.flatnonzero(after)
        self.end = stops[np.searchsorted(stops, self.start, side="right")] if len(self.start) else self.start
        codes = (_CODE[LOWER[data]] if lower else _CODE[data]) * _power("p", _P, len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes, out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * _power("inv", _P_INV, len(data) + 1)[self.start])
        self.first = np.searchsorted(self.start, bounds)

    def raw(self, i: int, j: int) -> bytes:
        """Bytes from word i to the end of word j - 1, as they stand in the text."""
        return self.data[self.start[i]:self.end[j - 1]].tobytes()

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def text_chunks(column, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds) in pieces of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def ngrams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every k consecutive word hashes; empty when there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = mix(np.array([seed * 2 + 1], np.uint64))[0] | np.uint64(1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * base + h[j:j + n]
    return mix(out + np.uint64(k))

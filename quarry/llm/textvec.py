"""Array kernels over UTF-8 text: word boundaries and fingerprints.

Everything works on the value buffer of an Arrow string array, so a batch of
documents is tokenised without making a Python object per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BASE_2 = np.uint64(0xC2B2AE3D27D4EB4F)
_BASE_2_INVERSE = np.uint64(pow(int(_BASE_2), -1, 1 << 64))
_BLOCK = 1 << 19

#: Bytes of words that end at the six ASCII white-space characters only.
WHITE = np.ones(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of words made of ASCII letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


class _Powers:
    """Powers of a base, kept and made longer when asked for."""

    def __init__(self, base: np.uint64):
        self.base, self.kept = base, np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if len(self.kept) < n:
            self.kept = _powers(self.base, max(n, _BLOCK))
        return self.kept[:n]


_POW, _INV = _Powers(_BASE), _Powers(_BASE_INVERSE)
_POW2, _INV2 = _Powers(_BASE_2), _Powers(_BASE_2_INVERSE)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values after which all bits depend on all."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and the n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = _BLOCK * 4):
    """Ranges of rows of at most `limit` bytes, or of one longer row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the index of its first word (n + 1 values)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = word[data]
    begin, end = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cut = cuts[inside[cuts] & inside[cuts + 1]]  # a word must not run over the end of a row
    begin[cut] = end[cut] = True
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end), np.searchsorted(starts, offsets)


def word_symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each word's bytes."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    with np.errstate(over="ignore"):
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + _BLOCK, "right")))
            at = starts[first]
            part = data[at : ends[last - 1]].astype(np.uint64)
            part += np.uint64(1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * _POW(len(part)), out=total[1:])
            s, e = starts[first:last] - at, ends[first:last] - at
            out[first:last] = (total[e] - total[s]) * _INV(len(part) + 1)[s] + (e - s).astype(np.uint64) * _BASE_2
            first = last
    return mix(out)


def gram_prints(symbols: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """A 64-bit fingerprint of each k consecutive symbols; `second` gives an independent one."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = (_POW2, _INV2) if second else (_POW, _INV)
    out = np.empty(n, np.uint64)
    with np.errstate(over="ignore"):
        for first in range(0, n, _BLOCK):
            part = symbols[first : first + _BLOCK + k - 1]
            if second:
                part = mix(part ^ _BASE)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * power(len(part)), out=total[1:])
            m = len(part) - k + 1
            out[first : first + m] = (total[k:] - total[:-k]) * inverse(m)
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out

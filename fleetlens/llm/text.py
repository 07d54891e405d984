"""Words, shingles and their hashes, straight from Arrow string buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D, so words of
UTF-8 texts can be found byte by byte. Buffers are worked on in pieces of
bounded size cut between words, whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15  # any odd number
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED = _CODES.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _CODES[ord("a") : ord("z") + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=2)
def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at.astype(np.int64)


def _cuts(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about PIECE_BYTES that begin and end between words."""
    start, end = int(offsets[0]), int(offsets[-1])
    while start < end:
        stop = min(start + PIECE_BYTES, end)
        if stop < end:
            doc = int(offsets[np.searchsorted(offsets, stop, "right") - 1])
            if doc > start:
                stop = doc
            else:
                limit = int(offsets[np.searchsorted(offsets, start, "right")])
                gap = np.flatnonzero(_SPACE[raw[start:stop]])
                while len(gap) == 0 and stop < limit:
                    ahead = min(stop + PIECE_BYTES, limit)
                    gap = np.flatnonzero(_SPACE[raw[stop:ahead]]) + (stop - start)
                    gap, stop = gap[:1], ahead
                stop = start + int(gap[-1]) + 1 if len(gap) else limit
        yield start, stop
        start = stop


def word_hashes(raw: np.ndarray, offsets: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and for each text where its words begin (n + 1 numbers).

    ``fold`` takes A-Z for a-z.
    """
    codes = _FOLDED if fold else _CODES
    hashes, firsts = [], []
    for start, stop in _cuts(raw, offsets):
        part = raw[start:stop]
        word = ~_SPACE[part]
        fresh = np.zeros(len(part) + 1, bool)
        fresh[offsets[(offsets >= start) & (offsets < stop)] - start] = True
        fresh[0] = fresh[-1] = True
        begins = np.flatnonzero(word & (fresh[:-1] | ~np.concatenate(([False], word[:-1]))))
        ends = np.flatnonzero(word & (fresh[1:] | ~np.concatenate((word[1:], [False])))) + 1
        n = max(len(part), PIECE_BYTES)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(codes[part] * powers(n, _BASE)[: len(part)], out=sums[1:])
        value = (sums[ends] - sums[begins]) * powers(n, _BASE_INVERSE)[begins]
        hashes.append(mix(value + (ends - begins).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        firsts.append(begins + start)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(firsts), offsets).astype(np.int64)


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; element i starts at word i."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    value = np.full(n, size, np.uint64)
    for j in range(size):
        value = value * np.uint64(0xA24BAED4963EE407) + words[j : j + n]
    return mix(value)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z folded; all words as one where there are fewer than ``size``."""
    words, at = word_hashes(*text_buffer(column), fold=True)
    for i in range(len(column)):
        own = words[at[i] : at[i + 1]]
        yield np.unique(grams(own, min(size, len(own)))) if len(own) else own


"""Vectorised word tokenizing and 64-bit hashing over Arrow string columns.

Texts are cut into blocks of about a megabyte; inside a block words are found and hashed with a handful of numpy
passes.  A word's hash is a polynomial of per-byte random values modulo 2**64, passed through an avalanche mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _table(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)], dtype=bool)


#: [^\x20\x09-\x0D]
SPACED = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F], after A-Z became a-z
ALNUM = _table(lambda b: b >= 0x80 or chr(b).isalnum())


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche 64-bit integers (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


class Block(NamedTuple):
    first: int  # row of the batch that the block starts with
    rows: int
    data: np.ndarray  # bytes of the block's texts, one after the other
    offsets: np.ndarray  # rows + 1 bounds of the texts in data
    starts: np.ndarray  # of words in data
    ends: np.ndarray
    bounds: np.ndarray  # rows + 1 bounds of the texts in the arrays of words
    hashes: np.ndarray  # of words


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)


def raw_blocks(column: pa.Array, most: int = BLOCK_BYTES, most_rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of runs of whole texts of at most `most` bytes and rows, or of one longer text."""
    offsets, data = _buffers(column)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, min(a + most_rows, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1))
        yield a, b - a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def blocks(column: pa.Array, word: np.ndarray = SPACED, fold: bool = True) -> Iterator[Block]:
    """Words of each text; fold: A-Z count as a-z.  A null text has no words."""
    for first, rows, data, offsets in raw_blocks(column):
        size = len(data)
        inside = np.zeros(size + 2, bool)
        inside[1:-1] = word[data]
        edge = np.zeros(size + 1, bool)
        edge[offsets] = True
        here, before = inside[1:], inside[:-1]
        starts = np.flatnonzero(here[:-1] & (~before[:-1] | edge[:-1]))
        ends = np.flatnonzero(before[1:] & (~here[1:] | edge[1:])) + 1
        up, down = _power(size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((_FOLDED if fold else _BYTE)[data] * up[:size], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        yield Block(first, rows, data, offsets, starts, ends, np.searchsorted(starts, offsets), hashes)


_COEFFICIENTS = mix(np.arange(1000, 1064, dtype=np.uint64)) | np.uint64(1)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive words; entry i is of the words i .. i + n - 1, whatever text they are in."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    if n > len(_COEFFICIENTS):
        raise ValueError(f"runs of more than {len(_COEFFICIENTS)} words aren't supported")
    total = np.full(count, n * 0xE7037ED1A0B428DB & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(n):
        total += hashes[k : k + count] * _COEFFICIENTS[k]
    return mix(total)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text: n-word runs, or the whole text as one if it has fewer words."""
    for block in blocks(column):
        runs = grams(block.hashes, n)
        for i in range(block.rows):
            a, b = int(block.bounds[i]), int(block.bounds[i + 1])
            if b - a >= n:
                yield block.first + i, np.unique(runs[a : b - n + 1])
            elif b > a:
                yield block.first + i, grams(block.hashes[a:b], b - a)
            else:
                yield block.first + i, np.empty(0, np.uint64)

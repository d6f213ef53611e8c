"""Shingle sets of many texts at once, as 64-bit hashes in NumPy.

Texts come as their words joined by single blanks, so that a shingle is a run of bytes between two words' bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche 64-bit integers (a bijection)."""
    x = x.astype(_U, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> _U(shift)
        x *= _U(factor)
    return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_powers: list[np.ndarray] = [np.empty(0, _U), np.empty(0, _U)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, BLOCK_BYTES + 1), _U(base))
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def polynomial(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes."""
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xA0761D6478BD642F))


_P = [_U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turn(x, n: int):
    return x << _U(n) | x >> _U(64 - n)


def _finish(h):
    h = (h ^ h >> _U(33)) * _P[1]
    h = (h ^ h >> _U(29)) * _P[2]
    return h ^ h >> _U(32)


def _word(h, x):
    return _turn(h ^ _turn(x * _P[1], 31) * _P[0], 27) * _P[0] + _P[3]


def xxhash_long(x: np.ndarray, seed) -> np.ndarray:
    """Spark's xxhash64 of a long with the hash so far as the seed."""
    return _finish(_word(seed + _P[4] + _U(8), x))


def xxhash_int(x: np.ndarray, seed) -> np.ndarray:
    """The same of an int, x in 64 bits without a sign."""
    return _finish(_turn(seed + _P[4] + _U(4) ^ x * _P[0], 23) * _P[1] + _P[2])


def xxhash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's xxhash64 of each run of bytes as a string; runs of one length at once."""
    out, lengths, seed = np.zeros(len(starts), _U), ends - starts, _U(seed)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(lengths[order]) > 0]) if len(order) else []
    for first, last in zip(cuts, [*cuts[1:], len(order)]):
        rows = order[first:last]
        n = int(lengths[rows[0]])
        run = np.ascontiguousarray(data[starts[rows][:, None] + np.arange(n)])
        at = 0
        if n >= 32:
            v = [np.full(len(rows), seed) + s for s in (_U((int(_P[0]) + int(_P[1])) % (1 << 64)), _P[1], _U(0), _U((1 << 64) - int(_P[0])))]
            words = np.ascontiguousarray(run[:, : n // 32 * 32]).view("<u8")
            for k in range(words.shape[1]):
                v[k % 4] = _turn(v[k % 4] + words[:, k] * _P[1], 31) * _P[0]
            h = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
            for x in v:
                h = (h ^ _turn(x * _P[1], 31) * _P[0]) * _P[0] + _P[3]
            at = n // 32 * 32
        else:
            h = np.full(len(rows), seed + _P[4], _U)
        h = h + _U(n)
        for at in range(at, n - 7, 8):
            h = _word(h, np.ascontiguousarray(run[:, at : at + 8]).view("<u8")[:, 0])
        at = n // 8 * 8
        if n - at >= 4:
            h = _turn(h ^ np.ascontiguousarray(run[:, at : at + 4]).view("<u4")[:, 0].astype(_U) * _P[0], 23) * _P[1] + _P[2]
            at += 4
        for k in range(at, n):
            h = _turn(h ^ run[:, k].astype(_U) * _P[4], 11) * _P[0]
        out[rows] = _finish(h)
    return out


def sets(column: pa.Array, n: int = 5, hashed=polynomial) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes) of each text's n-word runs; a text of fewer words is one, one without words has none."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, raw = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1)
        data, o = raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        begins = np.zeros(len(data) + 1, bool)
        begins[o] = True
        begins[1:][data == 32] = True
        starts = np.flatnonzero(begins[:-1])
        bounds = np.searchsorted(starts, o)
        ends = np.r_[starts[1:] - 1, len(data)][: len(starts)]
        some = bounds[1:] > bounds[:-1]
        ends[bounds[1:][some] - 1] = o[1:][some]
        long_ = bounds[1:] - bounds[:-1] >= n
        from_ = np.concatenate([np.arange(a, b - n + 1) if b - a >= n else np.arange(a, min(a + 1, b)) for a, b in zip(bounds[:-1], bounds[1:])])
        sizes = np.where(long_, bounds[1:] - bounds[:-1] - n + 1, some)
        to = from_ + np.repeat(np.where(long_, n - 1, bounds[1:] - bounds[:-1] - 1), sizes)
        found, at = hashed(data, starts[from_], ends[to]), np.r_[0, np.cumsum(sizes)]
        for i in range(last - first):
            yield first + i, np.unique(found[at[i] : at[i + 1]])
        first = last


def signature(found: np.ndarray) -> int:
    """An order-free hash of a set; sets of equal hashes and sizes count as equal."""
    return int((np.bitwise_xor.reduce(mix(found ^ _U(0x5851F42D4C957F2D)), keepdims=True) + np.add.reduce(mix(found), keepdims=True)).view(np.int64)[0])


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, _U).view(np.int64)

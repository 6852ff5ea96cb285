"""Hashed word-shingle sets of Arrow text columns, vectorised with numpy.

Words and shingles get 64-bit hashes: a polynomial hash of each word's bytes, then a mixed sum
over the words of a shingle. A set is the sorted array of its distinct hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_CHUNK = 1 << 21
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, _CHUNK + 1)
        for k, b in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            step = np.full(size, b, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers["up"][:n], _powers["down"]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data: bytes of several texts; bounds: their len + 1 offsets. Returns word hashes and the len + 1 offsets of each text's words."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = bounds[1:-1][bounds[1:-1] < n]
    first[inner] = word[inner]
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends = bounds[1:][bounds[1:] > 0] - 1
    last[ends] = word[ends]
    stops = np.flatnonzero(last) + 1
    up, down = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * up, out=total[1:])
    hashes = mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, bounds)


def sets_of(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row of a string column.

    Texts with fewer than `size` words have one shingle, the whole sequence; null or blank texts an empty set.
    """
    rng = np.random.default_rng(11)
    factor = rng.integers(1, 2**63, size, dtype=np.uint64) * _U(2) + _U(1)
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    _, where, body = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if where and len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(body, np.uint8) if body else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CHUNK, "right")) - 1)
        bounds = offsets[at : to + 1]
        hashes, words = word_hashes(data[bounds[0] : bounds[-1]], bounds - bounds[0])
        many = len(hashes) - size + 1
        mixed = mix(sum((hashes[k : k + many] * factor[k] for k in range(size)), np.zeros(many, np.uint64))) if many > 0 else hashes[:0]
        for k in range(to - at):
            a, b = int(words[k]), int(words[k + 1])
            if b - a >= size:
                found = np.sort(mixed[a : b - size + 1])
                yield at + k, found[np.r_[True, found[1:] != found[:-1]]]
            elif b > a:
                yield at + k, mix((hashes[a:b] * factor[: b - a]).sum(keepdims=True) + _U(b - a))
            else:
                yield at + k, hashes[:0]
        at = to

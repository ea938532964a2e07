"""Words and shingles of Arrow text columns as numpy arrays, hashed over the UTF-8 bytes without Python strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Odd multipliers; fixed, so that every executor and every run agrees.
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_A, _B = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
SLICE = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse to the powers 0 .. n - 1, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(max(n, SLICE), base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _A
    x = (x ^ (x >> _U(27))) * _B
    return x ^ (x >> _U(31))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column without nulls, and the rows' offsets in them."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of at most ``most`` bytes, or of one row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, min(end, n)
        row = end


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the words' ranges by row; words never cross rows."""
    inside = ~SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return begin, end, np.searchsorted(begin, offsets)


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; spans are disjoint and in order. Works through slices, so memory stays bounded."""
    out = np.empty(len(begin), np.uint64)
    k = 0
    while k < len(begin):
        last = max(k + 1, int(np.searchsorted(end, begin[k] + SLICE, "right")))
        first, stop = int(begin[k]), int(end[last - 1])
        up, down = powers(stop - first + 1)
        sums = np.zeros(stop - first + 1, np.uint64)
        np.cumsum((data[first:stop].astype(np.uint64) + _U(1)) * up[:-1], out=sums[1:])
        b, e = begin[k:last] - first, end[k:last] - first
        out[k:last] = mix((sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64) * _B)
        k = last
    return out


def shingles_of(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, distinct sorted shingle hashes of consecutive rows, their offsets by row), slice by slice.

    A row with fewer than ``size`` words has its whole sequence as one shingle, one without words none.
    """
    data, offsets = bytes_of(column)
    for row, stop in row_slices(offsets):
        part = LOWER[data[offsets[row] : offsets[stop]]]
        begin, end, by_row = words_of(part, offsets[row : stop + 1] - offsets[row])
        words, counts = hash_spans(part, begin, end), np.diff(by_row)
        full = np.maximum(len(words) - size + 1, 0)
        grams = np.zeros(full, np.uint64)
        for k in range(size):
            grams += words[k : k + full] * powers(size + 1)[0][k + 1]
        grams = mix(grams)
        sets = []
        for first, n in zip(by_row[:-1].tolist(), counts.tolist()):
            if n >= size:
                one = grams[first : first + n - size + 1]
                one.sort()
                sets.append(one[np.concatenate(([True], one[1:] != one[:-1]))] if len(one) > 1 else one)
            elif n:
                short = (words[first : first + n] * powers(size + 1)[0][1 : n + 1]).sum(dtype=np.uint64, keepdims=True)
                sets.append(mix(short + np.array([n], np.uint64) * _A))
            else:
                sets.append(words[:0])
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        yield row, np.concatenate(sets) if sets else words[:0], np.concatenate(([0], np.cumsum(sizes)))

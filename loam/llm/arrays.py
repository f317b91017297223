"""Words and their hashes of many texts at once, as numpy arrays over one UTF-8 buffer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
FACTOR = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(FACTOR, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    if (held := _powers.get(base)) is None or len(held) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        held = _powers[base] = np.multiply.accumulate(steps)
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of uint64 values over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes end to end, and where each begins, with the end; null counts as empty."""
    filled = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(flat: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run without separators, and how many runs each text has."""
    inside = np.zeros(len(flat) + 2, bool)
    inside[1:-1] = ~separator[flat]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < len(flat))]
    starts[edges] = inside[1:-1][edges]
    ends[edges - 1] = inside[1:-1][edges - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return first, last, np.diff(np.searchsorted(first, offsets))


def distinct(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of every span of ``flat``, equal for equal bytes alone, and the bytes of each number.

    Spans are ascending and do not overlap.
    """
    if len(starts) and (starts[1:] == ends[:-1]).all():
        data = flat[starts[0] : ends[-1]]
    else:
        marks = np.zeros(len(flat) + 1, np.int8)
        marks[starts] += 1
        marks[ends] -= 1
        data = flat[np.cumsum(marks[:-1], dtype=np.int8) > 0]
    offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    parts = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), parts).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def span_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH3 of every span of ``flat`` (see ``distinct``), as uint64; each distinct one is hashed once."""
    numbers, found = distinct(flat, starts, ends)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found.to_pylist()), np.uint64, len(found))[numbers]


class Hasher:
    """Fast hashes of spans of ``flat`` for hash buckets: a polynomial over the bytes, from running sums, then mixed.

    Long structured spans can agree though they differ, so these never tell spans apart; ``distinct`` does.
    """

    def __init__(self, flat: np.ndarray):
        self.sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * powers(FACTOR, len(flat)), out=self.sums[1:])
        self.inverse = powers(INVERSE, len(flat) + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

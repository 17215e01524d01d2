"""Word shingles of whole texts as 64-bit hashes, computed on arrays of a batch's bytes.

A word's hash is a polynomial over random values of its bytes, from prefix sums; a shingle's one combines its words'.
Texts are taken in lots of about one million bytes, so memory follows the longest text at most.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOT = 1 << 20
_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype="uint64") * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]  # A-Z as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers = [np.ones(1, "uint64"), np.ones(1, "uint64")]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, "uint64")
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed permutation of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends (in data) of all words, and the first word of each document (one more at the end).

    ends: len(documents) + 1 offsets into data, from 0.
    """
    n = len(data)
    if not n:
        return np.empty(0, "uint64"), np.empty(0, "int64"), np.empty(0, "int64"), np.zeros(len(ends), "int64")
    space = _SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[ends] = True
    after, before = np.ones(n, bool), np.ones(n, bool)
    after[1:], before[:-1] = space[:-1], space[1:]
    starts = np.flatnonzero(~space & (after | cut[:-1]))
    stops = np.flatnonzero(~space & (before | cut[1:])) + 1
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, "uint64")
    np.cumsum(_VALUE[data] * up[:n], out=sums[1:])
    lengths = (stops - starts).astype("uint64")
    return mixed((sums[stops] - sums[starts]) * down[starts] + lengths * _BASE), starts, stops, np.searchsorted(starts, ends)


def release() -> None:
    """Give freed memory back to the system; a worker that is used again would else keep its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lots(column: pa.Array, size: int = LOT) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of consecutive documents of about ``size`` bytes together; null texts are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.frombuffer(column.buffers()[1], "int64")[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], "uint8") if column.buffers()[2] else np.empty(0, "uint8")
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + size, side="right")) - 1)
        yield first, last, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last
    release()


def sets(data: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents' distinct shingle hashes one after another, sorted in each, and where each document's start."""
    hashes, _, _, first = words(data, ends)
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    m = len(hashes)
    made, of = [], []
    for size in range(1, k + 1):  # shorter documents are one shingle, of all their words
        if m >= size:
            at = np.flatnonzero(owner[: m - size + 1] == owner[size - 1 :])
            at = at[counts[owner[at]] == size] if size < k else at
            if len(at):
                acc = np.full(len(at), size, "uint64")
                for i in range(size):
                    acc = mixed(acc * _BASE + hashes[at + i])
                made.append(acc)
                of.append(owner[at])
    if not made:
        return np.empty(0, "uint64"), np.zeros(len(counts) + 1, "int64")
    value, doc = np.concatenate(made), np.concatenate(of)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[fresh], doc[fresh]
    return value, np.searchsorted(doc, np.arange(len(counts) + 1))

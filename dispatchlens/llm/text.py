"""Helpers shared by the text operators: Arrow text columns as flat byte arrays.

All functions here are small and run inside Spark tasks.  ``slices`` cuts an
Arrow batch into runs of rows of bounded text size, so the arrays an operator
builds are bounded by ``SLICE_BYTES`` (or by the longest single text).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x100000001B3)


def _table(chars: bytes, high: bool) -> np.ndarray:
    t = np.zeros(256, bool)
    t[np.frombuffer(chars, np.uint8)] = True
    t[128:] = high
    return t


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z became a-z, and its complement in UTF-8.
WORD = _table(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", True)
#: ``[^\x20\x09-\x0D]``
SOLID = ~_table(b" \t\n\x0b\x0c\r", False)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: spreads a 64-bit value over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def salt(k: int) -> np.uint64:
    """k times ``MIX`` modulo 2**64."""
    return np.uint64(k * int(MIX) & (1 << 64) - 1)


def uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1) doubles from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


#: A random 64-bit value per byte; the second table folds A-Z.
BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * MIX)
FOLDED_VALUE = BYTE_VALUE[LOWER]

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; those of a usual slice are kept per process."""
    kept = SLICE_BYTES + 1024
    have = _powers.get(int(base)) if n <= kept else None
    if have is None:
        have = np.ones(max(n, kept), np.uint64)
        np.cumprod(np.full(len(have) - 1, base, np.uint64), out=have[1:])
        if n <= kept:
            _powers[int(base)] = have
    return have[:n]


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the n + 1 row limits; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    limits = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[limits[0]:limits[-1]], limits - limits[0]


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in runs of at most ``most`` text bytes or one row."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(size), 0
        while at < len(size):
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def words(data: np.ndarray, limits: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the n + 1 limits of each row's words."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = table[data]
    first = np.zeros(n + 1, bool)
    first[limits] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, limits)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray = FOLDED_VALUE,
           base: np.uint64 = BASE) -> np.ndarray:
    """64-bit polynomial hash of each byte range, mixed; equal bytes give equal hashes anywhere."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * powers(base, len(data)), out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * powers(inverse(base), len(data) + 1)[starts])


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes (len(h) - n + 1 values)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * MIX + h[k:len(h) - n + 1 + k]
    return mix64(out)


def within(limits: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the total - n + 1 runs lie inside one row."""
    ok = np.ones(max(0, total - n + 1), bool)
    for k in range(1, n):
        cut = limits - k
        ok[cut[(cut >= 0) & (cut < len(ok)) & (limits < total)]] = False
    return ok

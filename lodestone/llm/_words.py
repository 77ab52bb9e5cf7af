"""Words and their hashes over Arrow text columns, in numpy: no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.ones(max(n, 1 << 20), np.uint64)
        have[1:] = base
        _powers[name] = have = np.cumprod(have)
    return have[:n]


def table(chars: bytes) -> np.ndarray:
    """256 booleans, true for the bytes given."""
    t = np.zeros(256, bool)
    t[np.frombuffer(chars, np.uint8)] = True
    return t


SPACE = table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Neither ASCII digit, lower-case letter nor part of a character beyond ASCII.
NOT_ALNUM = table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about limit bytes of text each; a longer text comes alone."""
    _, off = utf8(batch.column(column))
    at = 0
    while at < len(off) - 1:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cases A-Z and finds the words: (lower-cased bytes, starts, ends, words before each text and in all)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, np.zeros(len(offsets), np.int64)
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = ~separators[low]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets < len(data))]
    first[edge] |= inside[edge]
    edge = offsets[offsets > 0] - 1
    last[edge] |= inside[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, equal wherever they stand."""
    n = len(low)
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _power("up", BASE, n), out=total[1:])
    return mix((total[ends] - total[starts]) * _power("down", INVERSE, n)[starts])


def hashes_of_runs(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the runs of n values of h that begin at the places given, equal wherever they stand."""
    if not len(at):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h) * _power("up", BASE, len(h)), out=total[1:])
    return mix((total[at + n] - total[at]) * _power("down", INVERSE, len(h))[at])

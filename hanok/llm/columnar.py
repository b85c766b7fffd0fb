"""Byte-level views of Arrow text columns, shared by the operators that work in numpy inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column without copying; null is empty. Text i is ``bytes[offsets[i]:offsets[i + 1]]``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    first = int(offsets[0]) if len(column) else 0
    last = int(offsets[-1]) if len(column) else 0
    return np.frombuffer(data, np.uint8)[first:last], offsets - first if len(column) else np.zeros(1, np.int64)


def blocks(offsets: np.ndarray, most: int):
    """(first, end) row ranges of at most ``most`` bytes each, one row at least: bounds a task's temporaries."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


#: Byte classes: ASCII white space, and the lower-case image of A-Z.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of every word; a text's end closes a word."""
    inside = ~SPACE[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(len(data), bool)
    cuts = offsets[1:-1]
    edge[cuts[cuts < len(data)]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:]
    starts = np.flatnonzero(begins)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:]
    ends = np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A random 64-bit value for every byte, from a rule.
BYTE_VALUE = _splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: a polynomial over random byte values modulo 2^64, shifted to start at 1 and mixed."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * powers(BASE, len(data)), out=sums[1:])
        back = powers(BASE_INVERSE, len(data) + 1)[starts]
        return _splitmix((sums[ends] - sums[starts]) * back + (ends - starts).astype(np.uint64))

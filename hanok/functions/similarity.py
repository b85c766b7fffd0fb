"""Matching-block similarity of many pairs of names in step.

Twice the characters in matching blocks over all characters of both names. The first block is the longest run that both
names have (of equally long ones the first in the first name, then in the second); the parts before it and after it are
matched in the same way. All pairs of a batch go through this together: a round finds the longest run of every open part
in a padded matrix of characters, along all diagonals at once, and opens the two parts beside each run as pairs of their
own. Pairs that have too few characters in common, whatever their order, are told beforehand by sorting.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of one padded matrix; names from 200 characters on are matched one pair at a time.
CELLS, LONG = 1 << 20, 200
_PAD_A, _PAD_B = np.uint32(0xFFFFFFFF), np.uint32(0xFFFFFFFE)


def padded(names, pad: np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """(code points, one row per name, filled up with ``pad``; lengths)."""
    codes = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in names]
    size = np.array([len(c) for c in codes], np.int64)
    out = np.full((len(codes), int(size.max(initial=0))), pad, np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.concatenate([*codes, np.zeros(0, np.uint32)])
    return out, size


def in_common(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Characters that both names of each pair have, copies counted."""

    def numbered(codes, size):
        rows = np.sort(codes, axis=1)  # padding last
        new = np.ones(rows.shape, bool)
        new[:, 1:] = rows[:, 1:] != rows[:, :-1]
        at = np.arange(rows.shape[1])
        copy = at - np.maximum.accumulate(np.where(new, at, 0), axis=1)
        inside = at < size[:, None]
        pair = np.broadcast_to(np.arange(len(rows))[:, None], rows.shape)
        return (pair[inside].astype(np.uint64) << np.uint64(32)) | (rows[inside].astype(np.uint64) << np.uint64(10)) | copy[inside].astype(np.uint64)

    keys = np.sort(np.concatenate([numbered(a, la), numbered(b, lb)]))
    twice = keys[1:][keys[1:] == keys[:-1]]
    return np.bincount((twice >> np.uint64(32)).astype(np.int64), minlength=len(a))


def longest_runs(a: np.ndarray, b: np.ndarray, lo_a, hi_a, lo_b, hi_b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in a, start in b, length) of the longest common run of the parts a[lo_a:hi_a] and b[lo_b:hi_b] of each row."""
    n, width = b.shape
    column = np.arange(width)
    open_ = (column >= lo_b[:, None]) & (column < hi_b[:, None])
    run = np.zeros((n, width + 1), np.uint8)  # run[:, j + 1]: length of the run that ends at b[j] and the current row of a
    best, end_a, end_b = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(int(lo_a.min(initial=0)), int(hi_a.max(initial=0))):
        here = (a[:, i, None] == b) & open_ & ((i >= lo_a) & (i < hi_a))[:, None]
        run[:, 1:] = (run[:, :-1] + np.uint8(1)) * here
        at = run[:, 1:].argmax(axis=1)
        size = run[np.arange(n), at + 1]
        longer = size > best
        best[longer], end_a[longer], end_b[longer] = size[longer], i + 1, at[longer] + 1
    return end_a - best, end_b - best, best


def matched(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Characters in matching blocks of each pair."""
    total = np.zeros(len(a), np.int64)
    pair, zero = np.arange(len(a)), np.zeros(len(a), np.int64)
    part = (zero, la, zero, lb)
    while len(pair):
        lo_a, hi_a, lo_b, hi_b = part
        i, j, size = longest_runs(a[pair], b[pair], *part)
        np.add.at(total, pair, size)
        some = size > 0
        sides = [
            (pair[some], lo_a[some], i[some], lo_b[some], j[some]),
            (pair[some], (i + size)[some], hi_a[some], (j + size)[some], hi_b[some]),
        ]
        pair, *part = (np.concatenate(c) for c in zip(*sides, strict=True))
        left = (part[0] < part[1]) & (part[2] < part[3])
        pair, part = pair[left], tuple(c[left] for c in part)
    return total


def ratios(first, second, least: float = 0.0) -> np.ndarray:
    """Similarity of each pair; 0 where the characters in common show that ``least`` is out of reach."""
    first, second = np.asarray(first, object), np.asarray(second, object)
    la, lb = (np.array([len(x) for x in names], np.int64) for names in (first, second))
    out = np.where(la + lb == 0, 1.0, 0.0)
    long = np.maximum(la, lb) >= LONG
    if long.any():
        from difflib import SequenceMatcher

        out[long] = [SequenceMatcher(None, x, y).ratio() for x, y in zip(first[long], second[long], strict=True)]
    order = np.flatnonzero(~long & (la + lb > 0))
    order = order[np.argsort(np.maximum(la, lb)[order], kind="stable")]
    at = 0
    while at < len(order):
        step = max(1, CELLS // LONG)
        rows = order[at : at + step]
        at += step
        (a, na), (b, nb) = padded(first[rows], _PAD_A), padded(second[rows], _PAD_B)
        near = 2.0 * in_common(a, na, b, nb) >= least * (na + nb) - 1e-9
        rows, a, b, na, nb = rows[near], a[near], b[near], na[near], nb[near]
        out[rows] = 2.0 * matched(a, na, b, nb) / (na + nb)
    return out


def block_ratio(a, b, least: float = 0.0):
    """Column of the matching-block similarity of two names, null if one is; see :func:`ratios`."""

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known = (x.notna() & y.notna()).to_numpy()
        out = np.full(len(x), np.nan)
        out[known] = ratios(x[known], y[known], least)
        return pd.Series(out).where(known, None)

    return run(a, b)

"""Periodic runs of words by a sparse dynamic program over the diagonals of a text against itself.

The diagonal of lag p holds the places i where word i equals word i - p; m matches in a row there are a stretch of m + p
words with period p. A run needs m >= p and m + p >= ``SHORTEST``, so a lag only counts where it matches that long without
a break. That makes the program sparse: lags below ``DENSE`` are counted word by word for all texts at once; lags from G
to 2 G advance in blocks of G / 2 words. For each block the earlier occurrences of its words, found by a hash of the block
at that distance, add a block to the match length of their lag. Where a lag's next block is missing, its diagonal has
ended: the exact ends lie less than a block away on either side, and the stretch is emitted if it is long enough. Every
stretch long enough holds a whole block, so none is missed; a text of n words costs O(n log n) even if it is one word
repeated.

A stretch with period p that has a smaller period q as well is also a diagonal of lag q with the same ends, so of equal
stretches the smallest lag is the run's period.

Defined cases: words are parted by the six ASCII white-space characters; letter case counts; null and empty texts have no
words and no run; texts are read whole; repeated rows and null ids are rows like any other; extra columns play no part; an
empty table gives an empty result. Words are compared by 64-bit hashes, emitted stretches word by word; a text whose blocks
collide is counted on all its lags instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanok.llm.columnar import BASE, BASE_INVERSE, _splitmix, blocks, powers, ranges, span_hashes, text_bytes, words

SHORTEST, POWER = 12, 2
#: Lags below this are counted word by word.
DENSE = 16
#: Bytes of text at a time.
BLOCK = 1 << 22
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _stretches(match: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of each row of trues."""
    edge = np.diff(np.concatenate([[False], match, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _dense(ids: np.ndarray, of: np.ndarray, lags, shortest: int) -> list[np.ndarray]:
    """(start, end, lag) of the long stretches of these lags."""
    found = []
    for p in lags:
        first, end = _stretches((ids[p:] == ids[:-p]) & (of[p:] == of[:-p]))
        long = end - first >= max(p, shortest - p)
        found.append(np.stack([first[long], end[long] + p, np.full(int(long.sum()), p)], axis=1))
    return found


class _Prefix:
    """Hashes of any stretch of words from running sums."""

    def __init__(self, ids: np.ndarray):
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(ids) + 1, np.uint64)
            np.cumsum(_splitmix(ids) * powers(BASE, len(ids)), out=self.sums[1:])
            self.back = powers(BASE_INVERSE, len(ids) + 1)

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return _splitmix((self.sums[start + size] - self.sums[start]) * self.back[start])

    def common(self, at: np.ndarray, lag: np.ndarray, most: np.ndarray, side: int) -> np.ndarray:
        """Words that match at the lag without a break before (side -1) or from (side 1) each place, ``most`` at most."""
        low, high = np.zeros(len(at), np.int64), most.copy()
        while (low < high).any():
            size = (low + high + 1) // 2
            start = at - size if side < 0 else at
            same = self.of(start, size) == self.of(start - lag, size)
            low, high = np.where(same, size, low), np.where(same, high, size - 1)
        return low


def _blocked(prefix: _Prefix, first: np.ndarray, end: np.ndarray, g: int) -> np.ndarray:
    """(start, end, lag) of the long stretches with a lag from g to 2 g in the texts [first, end)."""
    b, size = g // 2, end - first
    n_blocks = size // b
    block = np.repeat(first, n_blocks) + ranges(np.zeros(len(first), np.int64), n_blocks) * b
    text_of_block = np.repeat(np.arange(len(first)), n_blocks)
    asked = prefix.of(block, b)
    # places whose words may be those of some block
    bits = np.uint64((1 << max(12, (8 * len(block)).bit_length())) - 1)
    seen = np.zeros(int(bits) + 1, bool)
    seen[(asked & bits).astype(np.int64)] = True
    place = ranges(first, size - b + 1)
    value = prefix.of(place, b)
    some = seen[(value & bits).astype(np.int64)]
    place, value = place[some], value[some]
    order = np.argsort(value, kind="stable")
    place, value = place[order], value[order]
    number = np.cumsum(np.concatenate([[0], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    width = int(end[-1]) + 1
    keys = number * width + place
    own = number[np.searchsorted(value, asked)] * width  # every block is itself a place
    low = np.searchsorted(keys, own + np.maximum(block - 2 * g + 1, first[text_of_block]))
    high = np.maximum(np.searchsorted(keys, own + np.maximum(block - g + 1, 0)), low)
    times = high - low
    at, t = np.repeat(block, times), np.repeat(text_of_block, times)
    lag = at - place[ranges(low, times)]
    order = np.lexsort((at, lag))
    at, lag, t = at[order], lag[order], t[order]
    ends = np.flatnonzero(np.concatenate([(lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + b), np.ones(min(1, len(at)), bool)]))
    begins = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)[: len(ends)]
    a, z, lag, t = at[begins], at[ends] + b, lag[ends], t[ends]
    may = z - a + 2 * (b - 1) >= lag
    a, z, lag, t = a[may], z[may], lag[may], t[may]
    a = a - prefix.common(a, lag, np.minimum(b - 1, a - lag - first[t]), -1)
    z = z + prefix.common(z, lag, np.minimum(b - 1, end[t] - z), 1)
    long = z - a >= lag
    return np.stack([a[long] - lag[long], z[long], lag[long]], axis=1)


def _exact(ids: np.ndarray, found: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each stretch (start, end, lag) matches word by word and can't be longer."""
    start, stop, lag = found.T
    size = stop - start - lag
    here = ranges(start + lag, size)
    wrong = np.flatnonzero(ids[here] != ids[here - np.repeat(lag, size)])
    right = np.ones(len(found), bool)
    right[np.searchsorted(np.cumsum(size), wrong, side="right")] = False
    left = (start > first) & (ids[np.maximum(start - 1, 0)] == ids[np.minimum(start - 1 + lag, len(ids) - 1)])
    after = (stop < end) & (ids[np.minimum(stop, len(ids) - 1)] == ids[np.minimum(stop, len(ids) - 1) - lag])
    return right & ~left & ~after


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Of stretches (start, end, lag) with equal ends that of the smallest lag."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.concatenate([np.ones(min(1, len(rows)), bool), (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])]


def find(ids: np.ndarray, counts: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """(start, end, period) of all runs, in word numbers over all texts; ``counts`` are the texts' words. Sorted by start, then period."""
    end = np.cumsum(counts)
    first, of = end - counts, np.repeat(np.arange(len(counts)), counts)
    found = _dense(ids, of, range(1, min(DENSE, len(ids))), shortest)
    prefix, g, blocked = None, DENSE, []
    while (long := counts >= POWER * g).any():
        prefix = prefix or _Prefix(ids)
        blocked.append(_blocked(prefix, first[long], end[long], g))
        g *= 2
    rows = _smallest(np.concatenate([np.zeros((0, 3), np.int64), *found, *blocked]))
    if blocked:
        text = of[rows[:, 0]]
        sure = rows[:, 2] < DENSE
        sure[~sure] = _exact(ids, rows[~sure], first[text[~sure]], end[text[~sure]])
        again = np.unique(text[~sure])
        if len(again):  # colliding hashes: these texts' lags one by one
            parts = [np.concatenate(_dense(ids[first[t] : end[t]], of[first[t] : end[t]], range(1, counts[t] // POWER + 1), shortest)) + [first[t], first[t], 0] for t in again]
            rows = _smallest(np.concatenate([rows[~np.isin(text, again)], *parts]))
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: np.ndarray, n: int, runs: np.ndarray) -> pa.Array:
    """The texts without the words that a run repeats after its first period, joined by one space."""
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    starts, sizes, of = starts[kept], (ends - starts)[kept] + 1, of[kept]
    out = np.append(data, 32)[ranges(starts, sizes)].astype(np.uint8)
    stops = np.cumsum(sizes)
    out[stops - 1] = 32
    last = np.concatenate([of[1:] != of[:-1], np.ones(min(1, len(of)), bool)])
    out = np.delete(out, stops[last] - 1)  # no space after a text's last word
    size = np.bincount(of, sizes, n).astype(np.int64)
    size[of[last]] -= 1
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.binary())


def _batch(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, z in blocks(offsets, BLOCK):
                part, cuts = data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
                starts, ends, of = words(part, cuts)
                counts = np.bincount(of, minlength=z - a)
                rows = find(span_hashes(part, starts, ends), counts, shortest)
                text = of[rows[:, 0]] if len(rows) else np.zeros(0, np.int64)
                per_text = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=z - a))])
                fields = [rows[:, 0] - (np.cumsum(counts) - counts)[text], rows[:, 1] - rows[:, 0], rows[:, 2]]
                spans = pa.StructArray.from_arrays([pa.array(f.astype(np.int64)) for f in fields], names=["start", "length", "period"])
                columns = [
                    batch.column("doc_id").slice(a, z - a),
                    pa.array(counts.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), spans),
                    _collapsed(part, starts, ends, of, z - a, rows),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of ``docs(doc_id, text)``: runs by start, then period, in word numbers;
    collapsed is the text's words without those that repeat a run's first period, joined by one space."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_batch(shortest), f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))

"""Removal of repeated strings: every byte covered by a ``WINDOW``-byte string that starts anywhere else too.

Equal windows hold the same ``GRAM``-byte anchor at the same place (the window's smallest gram by hash, the leftmost of
equals), so windows need only be compared under one anchor, aligned at it. A document is cut into segments, one for each
anchor: the windows that have it and no more, hence no window is in two segments and every equality is a repeat.

1. Anchors that occur once are dropped by a grouped count; of the others, segments that occur twice are wholly repeated.
2. Different segments under one anchor go, once each, to a column-wise multi-document construction: aligned at their
   anchors, one symbol of every segment is inserted per round, from the last column to the first. A round turns the order
   of all suffixes and their longest common prefixes into those of the suffixes one symbol longer: the symbols in the old
   order are the column of the collection's Burrows-Wheeler transform, a stable sort of that column is the new order, and
   the new common prefixes are range minima of the old ones plus one. A common prefix of ``WINDOW`` marks both windows.
   The symbols lie in one sequential file per column in the task's own scratch folder and are read once; a task holds
   some bytes per segment, not the segments. Suffixes of different columns are never equal windows, so the transform is
   kept by column and not merged over columns; see the README for what the merge would cost.
3. Anchors with over ``CROWD`` different segments would be one task's work. Their windows are counted instead by digest,
   with map-side sums, and found again by a join.

Intermediates are staged in the shared folder; each step's shuffle files go when it ends.

Defined cases: null is empty; texts shorter than a window lose nothing; a text that repeats a window within itself loses
both; matches never cross rows, and repeated rows repeat each other. Long texts are handled whole, in pieces that share no
window. Rows are told apart by doc_id and text; a null doc_id is an id of its own. Extra columns play no part. An empty
table gives an empty result.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanok.llm.columnar import BASE, BASE_INVERSE, BYTE_VALUE, _splitmix, blocks, powers, text_bytes
from hanok.llm.tables import staged

WINDOW, GRAM = 200, 32
#: Bytes of a block, different segments of a crowded anchor, and segments that may be broadcast as frequent.
BLOCK, CROWD, HOT = 1 << 21, 20_000, 10_000
REACH = WINDOW - GRAM  # an anchor starts at most so far into its window
COLUMNS = REACH + WINDOW


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, segment hash, text number, first window, windows, bytes before the anchor) of all segments of a block."""
    n = len(data)
    if n < WINDOW:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * powers(BASE, n), out=sums[1:])
        back = powers(BASE_INVERSE, n)
        grams = _splitmix((sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1])
        low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= REACH + 1:  # smallest of the next 2, 4, ... grams; equals go to the leftmost
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if rest := REACH + 1 - width:
            low = np.minimum(low[:-rest], low[rest:])
        anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        sizes = np.maximum(np.diff(offsets) - WINDOW + 1, 0)
        text = np.repeat(np.arange(len(sizes)), sizes)
        at = np.repeat(offsets[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(text))
        anchor = anchor[at]
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        start, anchor = at[first], anchor[first]
        whole = _splitmix((sums[start + count + WINDOW - 1] - sums[start]) * back[start] + count.astype(np.uint64))
    return grams[anchor], whole, text[first], start - offsets[text[first]], count, anchor - start


def _pieces(offsets: np.ndarray):
    """(first row, end row, from, to) of blocks of whole texts, and of pieces of texts beyond a block."""
    for a, b in blocks(offsets, BLOCK):
        low, high = int(offsets[a]), int(offsets[b])
        if high - low <= BLOCK:
            yield a, b, low, high
        else:
            for s in range(low, max(high - WINDOW + 1, low + 1), BLOCK):
                yield a, b, s, min(s + BLOCK + WINDOW - 1, high)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for a, b, low, high in _pieces(offsets):
            cuts = np.clip(offsets[a : b + 1], low, high) - low
            anchor, whole, text, lo, run, left = segments(data[low:high], cuts)
            lo = lo + np.maximum(low - offsets[a + text], 0)
            rows = pa.array(a + text)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), batch.column("doc_id").take(rows), batch.column("th").take(rows),
                    pa.array(lo.astype(np.int32)), pa.array(run.astype(np.int32)), pa.array(left.astype(np.int32)),
                ],
                names=["anchor", "seg", "doc_id", "th", "lo", "run", "left"],
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the segments listed for each text."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        lists = batch.column("parts")
        parts, rows = lists.flatten(), lists.value_parent_indices().to_numpy()
        lo, run = (pc.struct_field(parts, f).to_numpy() for f in ("lo", "run"))
        start = offsets[rows] + lo
        raw = data.tobytes()
        texts = [raw[s : s + n + WINDOW - 1] for s, n in zip(start.tolist(), run.tolist(), strict=True)]
        kept = [pc.struct_field(parts, f) for f in ("anchor", "seg", "n", "lo", "run", "left", "crowded")]
        ids = [batch.column(c).take(pa.array(rows)) for c in ("doc_id", "th")]
        yield pa.RecordBatch.from_arrays([*ids, *kept, pa.array(texts, pa.binary())], names=["doc_id", "th", "anchor", "seg", "n", "lo", "run", "left", "crowded", "bytes"])


def shared_windows(column, starts: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which windows (row: segment, column: window) of aligned segments occur in another segment at the same column.

    ``column(j)`` gives the symbols of all segments in column j; segment i covers ``runs[i] + WINDOW - 1`` columns from
    ``starts[i]``.
    """
    m = len(starts)
    found = np.zeros((m, REACH + 1), bool)
    order, common = np.arange(m), np.zeros(m, np.int16)
    ends = starts + runs + WINDOW - 1
    for j in range(COLUMNS - 1, -1, -1):
        symbol = np.where((starts <= j) & (j < ends), column(j).astype(np.uint16) + 1, 0).astype(np.uint16)
        transform = symbol[order]
        place = np.argsort(transform, kind="stable")
        order, transform = order[place], transform[place]
        same = np.flatnonzero((transform[1:] == transform[:-1]) & (transform[1:] > 0))
        longer = np.zeros(m, np.int16)
        if len(same):
            first, size = place[same] + 1, place[same + 1] - place[same]
            levels = [common]  # smallest of the next 1, 2, 4, ... common prefixes
            for k in range(int(size.max()).bit_length() - 1):
                low = levels[-1].copy()
                low[: -(1 << k)] = np.minimum(low[: -(1 << k)], levels[-1][1 << k :])
                levels.append(low)
            table = np.stack(levels)
            k = np.frexp(size)[1] - 1
            longer[same + 1] = 1 + np.minimum(table[k, first], table[k, first + size - (1 << k)])
        common = longer
        hit = np.flatnonzero(common >= WINDOW)
        both = np.concatenate([order[hit], order[hit - 1]])
        found[both, j - starts[both]] = True
    return found


def _construct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows of this task's segments that occur once; the symbols go through column files."""
    held: list[pa.RecordBatch] = []
    with tempfile.TemporaryDirectory(prefix="columns-") as folder:  # this task's scratch, gone with it
        names = [os.path.join(folder, str(j)) for j in range(COLUMNS)]
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = text_bytes(batch.column("bytes").cast(pa.large_binary()).view(pa.large_string()))
            matrix = np.zeros((batch.num_rows, COLUMNS), np.uint8)
            size = np.diff(offsets)
            row = np.repeat(np.arange(batch.num_rows), size)
            matrix[row, np.arange(len(data)) - np.repeat(offsets[:-1], size) + np.repeat(REACH - batch.column("left").to_numpy(), size)] = data
            for name, symbols in zip(names, np.ascontiguousarray(matrix.T), strict=True):
                with open(name, "ab") as f:
                    f.write(symbols.tobytes())
            held.append(batch.drop_columns(["bytes"]))
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        starts = REACH - table["left"].to_numpy().astype(np.int64)
        found = shared_windows(lambda j: np.fromfile(names[j], np.uint8), starts, table["run"].to_numpy().astype(np.int64))
    found[table["n"].to_numpy() > 1] = False  # known to be repeated as a whole
    edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edges == 1)
    end = np.nonzero(edges == -1)[1]
    if len(row):
        lo = table["lo"].to_numpy()[row]
        ids = [table[c].combine_chunks().take(pa.array(row)) for c in ("doc_id", "th")]
        yield pa.RecordBatch.from_arrays([*ids, pa.array((lo + first).astype(np.int32)), pa.array((lo + end + WINDOW - 1).astype(np.int32))], names=["doc_id", "th", "a", "b"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        raw, marks, out = data.tobytes(), batch.column("marks").to_pylist(), []
        for i, listed in enumerate(marks):
            low, high = int(offsets[i]), int(offsets[i + 1])
            text = raw[low:high]
            if not listed:
                out.append((high - low, [], [], text))
                continue
            spans = np.array(sorted((x["a"], x["b"]) for x in listed))
            upto = np.maximum.accumulate(spans[:, 1])
            new = np.concatenate([[True], spans[1:, 0] > upto[:-1]])
            begins, ends = spans[new, 0].tolist(), upto[np.append(np.flatnonzero(new)[1:] - 1, len(upto) - 1)].tolist()
            edges = [0, *[x for pair in zip(begins, ends, strict=True) for x in pair], high - low]
            out.append((high - low, begins, ends, b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))))
        columns = zip(*out, strict=True) if out else [[]] * 4
        types = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=["doc_id", "n_bytes", "removed_from", "removed_to", "kept"])


def _by_text(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``rows`` with the columns that ``found`` holds for their (doc_id, th)."""
    other = found.withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    return rows.join(other, rows["doc_id"].eqNullSafe(other["_id"]) & (rows["th"] == other["_th"]), how).drop("_id", "_th")


def _crowded_marks(parts: DataFrame) -> DataFrame:
    """Marks of the segments under crowded anchors: windows counted by digest."""
    window = F.substring("bytes", F.col("w") + 1, F.lit(WINDOW))
    windows = parts.select("doc_id", "th", "n", "lo", "bytes", F.explode(F.sequence(F.lit(0), F.col("run") - 1)).alias("w"))
    windows = windows.select("doc_id", "th", "n", (F.col("lo") + F.col("w")).alias("a"), F.unhex(F.md5(window)).alias("digest"))
    twice = windows.groupBy("digest").agg(F.count("*").alias("c")).filter("c > 1").select("digest")
    return windows.filter("n = 1").join(twice, "digest").select("doc_id", "th", "a", (F.col("a") + WINDOW).cast("int").alias("b"))


def remove_repeats(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, removed_from, removed_to, kept), one row per row of ``docs(doc_id, text)``: the maximal removed
    byte ranges [from, to) and the bytes that stay."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    id_type = dict(rows.dtypes)["doc_id"]
    ids = f"doc_id {id_type}, th bigint"
    all_ = rows.mapInArrow(_occurrences, f"anchor bigint, seg bigint, {ids}, lo int, run int, left int")
    again = all_.groupBy("anchor").agg(F.count("*").alias("c"), F.min("seg").alias("s"), F.max("seg").alias("t")).filter("c > 1")
    again = staged(again.select("anchor", (F.col("s") != F.col("t")).alias("differ")), "anchors")
    met = staged(all_.join(again, "anchor"), "occurrences")

    place = F.min(F.struct("doc_id", "th", "lo", "run", "left")).alias("p")
    each = staged(met.filter("differ").groupBy("anchor", "seg").agg(F.count("*").alias("n"), place).select("anchor", "seg", "n", "p.*"), "segments")
    many = each.groupBy("anchor").agg(F.count("*").alias("c")).filter(F.col("c") > crowd).select("anchor", F.lit(True).alias("crowded"))
    told = each.join(many, "anchor", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    listed = told.groupBy("doc_id", "th").agg(F.collect_list(F.struct("anchor", "seg", "n", "lo", "run", "left", "crowded")).alias("parts"))
    cut = _by_text(rows, listed, "inner").mapInArrow(_cut, f"{ids}, anchor bigint, seg bigint, n bigint, lo int, run int, left int, crowded boolean, bytes binary")
    parts = staged(cut, "parts")
    columns = parts.filter("not crowded").select("anchor", "doc_id", "th", "n", "lo", "run", "left", "bytes").repartition("anchor").drop("anchor")
    marks = columns.mapInArrow(_construct, f"{ids}, a int, b int").unionByName(_crowded_marks(parts.filter("crowded")))

    # segments that occur often, at most HOT by their count, are found without a shuffle
    often = max(2, met.count() // HOT + 1)
    hot = F.broadcast(each.filter(F.col("n") >= often).select("anchor", "seg", F.lit(True).alias("hot")))
    told = met.filter("differ").join(hot, ["anchor", "seg"], "left")
    rest = told.filter("hot is null").join(each.filter((F.col("n") > 1) & (F.col("n") < often)).select("anchor", "seg"), ["anchor", "seg"], "left_semi")
    whole = met.filter("not differ").unionByName(told.filter("hot").drop("hot")).unionByName(rest.drop("hot"))
    marks = staged(marks.unionByName(whole.select("doc_id", "th", F.col("lo").alias("a"), (F.col("lo") + F.col("run") + WINDOW - 1).cast("int").alias("b"))), "marks")
    by_text = marks.groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "b")).alias("marks"))  # repeated rows bring the same marks
    marked = _by_text(rows, by_text, "left").select("doc_id", "text", "marks")
    return marked.mapInArrow(_remove, f"doc_id {id_type}, n_bytes bigint, removed_from array<int>, removed_to array<int>, kept binary")

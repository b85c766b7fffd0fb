"""SimHash near-duplicates by anchor-point covering.

Anchors are the codewords of a product of repetition codes: the 64 bits are cut into ``blocks`` runs, and a codeword is
constant on each run. A fingerprint's home is the nearest anchor (the majority of each run, a tie counting as ones), so
the covering radius R is the sum of half the run lengths. A fingerprint is copied to each anchor within R + threshold
whose cell it can enter by at most ``threshold`` flipped bits; every pair within the threshold then meets at the home of
either. The runs get shorter as the fingerprints grow in number, so that a cell holds a bounded mean number of homes.

Only distinct fingerprints travel: copies of one text are one fingerprint whatever their number. Cells are compared in
numpy in blocks; a crowded cell is first cut into tiles of homes and visitors, so no task holds more than one tile. A tile
returns the links of a spanning forest, at most one per member, and the groups are closed by label rounds, checkpointed in
the shared folder.

Defined cases: null and empty texts have no shingle and the fingerprint zero, linked like any other; a text with fewer
words than a shingle is one shingle; repeated shingles count as often as they occur; texts are hashed whole. A null doc_id
is never the id of a group unless it is alone. Repeated rows get equal results. Extra columns play no part. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanok.llm.tables import staged
from hanok.operators.graph import connected_groups

SHINGLE, THRESHOLD, SEED = 3, 2, 42
#: Mean homes a cell may hold, homes and visitors of one tile.
CELL, TILE_HOMES, TILE_VISITORS = 64, 2_000, 60_000


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """64-bit fingerprint of a text in UTF-8: a bit is 1 if it is set in over half of the shingles' XXH64 values."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    ends = [x - 1 for x in starts[width:]] or [len(joined)]
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=False)], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_in = np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            values = np.array([fingerprint((t.as_py() or "").encode(), width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def runs(blocks: int) -> list[tuple[int, int]]:
    """(first bit, length) of each run."""
    return [(64 * i // blocks, 64 * (i + 1) // blocks - 64 * i // blocks) for i in range(blocks)]


def blocks_for(count: int) -> int:
    """Runs such that a cell holds about ``CELL`` homes of ``count`` fingerprints; beyond 24 copies outgrow the gain."""
    return min(24, max(8, (max(count, 1) // CELL).bit_length()))


def cover(fps: np.ndarray, blocks: int, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) of all copies of the fingerprints (uint64). An anchor is one bit per run."""
    row = np.arange(len(fps))
    anchor = np.zeros(len(fps), np.int64)
    flip = []
    for i, (first, length) in enumerate(runs(blocks)):
        ones = np.bitwise_count((fps >> np.uint64(first)) & np.uint64((1 << length) - 1)).astype(np.int64)
        major = 2 * ones >= length
        anchor |= major.astype(np.int64) << i
        # fewest flips that change the majority: down to below half, or up to half
        flip.append(np.where(major, ones - (length - 1) // 2, (length + 1) // 2 - ones))
    left = np.full(len(fps), threshold)
    for i in range(blocks):
        able = np.flatnonzero(flip[i][row] <= left)
        left = np.concatenate([left, left[able] - flip[i][row[able]]])
        anchor = np.concatenate([anchor, anchor[able] ^ (1 << i)])
        row = np.concatenate([row, row[able]])
    return row, anchor, np.arange(len(row)) < len(fps)


def _forest(homes: np.ndarray, visitors: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of a spanning forest of all pairs (home, visitor) within the threshold."""
    nodes = np.unique(np.concatenate([homes, visitors]))
    label, at = np.arange(len(nodes)), np.searchsorted(nodes, visitors)
    step = max(1, 4_000_000 // max(len(visitors), 1))
    for s in range(0, len(homes), step):
        part = homes[s : s + step]
        h, v = np.nonzero(np.bitwise_count(part[:, None] ^ visitors[None, :]) <= threshold)
        p, q = np.searchsorted(nodes, part)[h], at[v]
        while len(p):
            low = np.minimum(label[p], label[q])
            np.minimum.at(label, label[p], low)
            np.minimum.at(label, label[q], low)
            label = label[label]
            apart = label[p] != label[q]
            p, q = p[apart], q[apart]
    while (label != label[label]).any():
        label = label[label]
    member = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[member]], nodes[member]


def _compare(threshold: int):
    """Tiles arrive sorted by key; rows of the tile under way are kept until the next one begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def linked(table: np.ndarray):
            a, b = _forest(table[table[:, 3] == 1, 4].view(np.uint64), table[:, 4].view(np.uint64), threshold)
            return a.view(np.int64), b.view(np.int64)

        def out(found):
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("anchor", "tile_h", "tile_v", "home", "fp")], axis=1)
            rows = np.concatenate([*held, rows])
            cuts = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            tiles = np.split(rows, cuts)
            held = [tiles.pop()]
            yield from out([linked(np.ascontiguousarray(t)) for t in tiles if len(t) > 1])
        if held and len(held[0]) > 1:
            yield from out([linked(np.ascontiguousarray(held[0]))])

    return run


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fps(fp)`` exactly as all pairs within the threshold do."""
    blocks = blocks_for(fps.count())

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy()
            row, anchor, home = cover(values.view(np.uint64), blocks, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(values[row]), pa.array(home.astype(np.int32))], names=["anchor", "fp", "home"])

    copies = fps.select("fp").mapInArrow(copy, "anchor bigint, fp bigint, home int")
    sizes = copies.groupBy("anchor").agg(F.sum("home").alias("homes"), F.count("*").alias("visitors"))
    crowded = sizes.filter((F.col("homes") > TILE_HOMES) | (F.col("visitors") > TILE_VISITORS)).select(
        "anchor", F.ceil(F.col("homes") / TILE_HOMES).cast("int").alias("n_h"), F.ceil(F.col("visitors") / TILE_VISITORS).cast("int").alias("n_v")
    )
    dealt = copies.join(staged(crowded, "crowded"), "anchor", "left").na.fill(1, ["n_h", "n_v"])
    # a home goes to every tile column as a home, a visitor to every tile row; with one tile a fingerprint is sent once
    own_h, own_v = F.pmod(F.xxhash64("fp"), "n_h").cast("int"), F.pmod(F.xxhash64("fp", F.lit(1)), "n_v").cast("int")
    whole = dealt.filter("n_h = 1 and n_v = 1").select("anchor", F.lit(0).alias("tile_h"), F.lit(0).alias("tile_v"), "home", "fp")
    cut_up = dealt.filter("n_h > 1 or n_v > 1")
    as_home = cut_up.filter("home = 1").select("anchor", own_h.alias("tile_h"), F.explode(F.sequence(F.lit(0), F.col("n_v") - 1)).alias("tile_v"), "home", "fp")
    as_visitor = cut_up.select("anchor", F.explode(F.sequence(F.lit(0), F.col("n_h") - 1)).alias("tile_h"), own_v.alias("tile_v"), F.lit(0).alias("home"), "fp")
    tiles = whole.unionByName(as_home).unionByName(as_visitor)
    key = ["anchor", "tile_h", "tile_v"]
    return tiles.repartition(*key).sortWithinPartitions(*key).mapInArrow(_compare(threshold), "a bigint, b bigint").distinct()


def near_groups(docs: DataFrame, width: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs(doc_id, text)``."""
    rows = staged(fingerprints(docs, width), "fingerprints")
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = staged(links(distinct, threshold), "links")
    nodes = found.select(F.col("a").alias("id")).unionByName(found.select(F.col("b").alias("id"))).distinct()
    groups = connected_groups(nodes, found)
    members = distinct.join(groups.withColumnRenamed("id", "fp"), "fp")
    least = members.groupBy("group_id").agg(F.min("first_id").alias("component_id"))
    linked = members.join(least, "group_id").select("fp", "component_id")
    named = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, width: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group; rows that share a doc_id are one document."""
    stay = near_groups(docs, width, threshold).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_sh_id")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["_sh_id"]), "left_semi")

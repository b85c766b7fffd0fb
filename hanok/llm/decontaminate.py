"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are hashed; a fixed mask takes some of the next words and ignores the others, so that a substituted word does not
break a seed. Masked hashes of the benchmark are joined with those of the documents. Each hit fixes an alignment of an
item with a document; along it the words are compared one by one, and a window of ``WINDOW`` words (the whole item, if it
is shorter) that agrees in at least ``SIMILARITY`` of them is an overlap. The two masks together find every window of 13
words with any two substitutions, and every window of 20 with any four. Shorter items lose all seeds of those to a
substitution in the wrong place; they have masks of four words, which find every item of 5 to 12 words that agrees in
``SIMILARITY``. Documents are seeded with these only if the benchmark has such items.

The seeds of the benchmark are broadcast only if a count shows at most ``MOST_SEEDS`` rows; a larger benchmark is joined by
an ordinary shuffle. Equal items are compared once and share the finding of the smallest item_id.

A phrase that many items and many documents use ("which of the following") would align each of these documents with each
of these items. A window that agrees in ``SIMILARITY`` of its words around a seed has a least number of equal words beyond
the seed, so of an item's n words in reach the document must hold one of the n - least + 1 that are rarest among the items
with this seed. Seeds of more than ``CROWD`` places in the benchmark are joined by (seed, place, word) of these, which loses
no window; the phrase itself is among the words left out.

Defined cases: words are runs of letters and digits after lower-casing, so punctuation glued to words does not hide a
passage; null and empty texts have no words; items of fewer than ``SHORTEST`` words are no evidence and never match; long
texts are read whole; rows that share a doc_id are one document, each aligned by its own words, and a null id is an id of its own; a null item_id is
an id like any other, and different items that share an item_id are reported as one, by the best window of any. Extra
columns play no part. An empty documents or benchmark table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hanok.llm.tables import staged

#: 1: the word counts, 0: any word.
MASKS = ("11111", "11100101")
#: For windows below ``SHORT`` words: one substitution in any five words leaves one of these whole, so 5 to 9 words may
#: lose one and 10 to 12 two (one half then has at most one).
SHORT_MASKS, SHORT = ("1111", "11101", "11011", "10111"), 13
WINDOW, SIMILARITY, SHORTEST = 13, 0.8, 5
MOST_SEEDS = 2_000_000
#: Places of the benchmark with one seed from which on it needs a word beyond it.
CROWD = 32


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def seeds(rows: DataFrame, key: str, masks: Sequence[str] = MASKS) -> DataFrame:
    """(key, pos, seed) of every masked window of ``rows(key, hashes)``; pos counts words from 0. Seeds are told apart by mask."""
    offsets = sorted({i for m in masks for i, c in enumerate(m) if c == "1"})
    n = F.size("hashes")
    columns = [F.slice("hashes", F.lit(o + 1), n).alias(f"w{o}") for o in offsets]
    at = rows.filter(n >= min(map(len, masks))).select(key, F.posexplode(F.arrays_zip(*columns)).alias("pos", "w"))

    def one(mask: str) -> Column:
        used = [F.col(f"w.w{i}") for i, c in enumerate(mask) if c == "1"]
        return F.when(used[-1].isNotNull(), F.xxhash64(F.lit(int(mask, 2)), *used))  # the last word is there, so all are

    made = at.select(key, "pos", F.explode(F.array(*[one(m) for m in masks])).alias("seed"))
    return made.filter("seed is not null")


def _hashed(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _broadcast(rows: DataFrame, most: int) -> DataFrame:
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def _item_seeds(hashed: DataFrame, masks: Sequence[str], size: Column, similarity: float) -> DataFrame:
    """(item_key, item_pos, seed, mask, size, least): ``least`` is the number of equal words that a window of ``size`` has beyond
    the seed's own."""
    sized = hashed.select("item_key", size.alias("size"))
    made = [seeds(hashed, "item_key", [m]).select("*", F.lit(m).alias("mask"), F.lit(m.count("1")).alias("own")) for m in masks]
    least = F.ceil(F.lit(similarity) * F.col("size") - 1e-9).cast("int") - F.col("own")
    return reduce(DataFrame.unionByName, made).join(sized, "item_key").select("item_key", F.col("pos").alias("item_pos"), "seed", "mask", "size", least.alias("least"))


def _neighbours(masks: Sequence[str], window: int, pos: str, size: Column) -> Column:
    """Keys (seed, offset, word) of the words that a window of ``size`` around the seed at ``pos`` of ``hashes`` may hold beside it."""
    beside = {m: [o for o in range(len(m) - window, window) if not (0 <= o < len(m) and m[o] == "1")] for m in masks}
    offsets = F.coalesce(*[F.when(F.col("mask") == m, F.array(*map(F.lit, found))) for m, found in beside.items()])
    inside = F.filter(offsets, lambda o: (F.col(pos) + o >= 0) & (F.col(pos) + o < F.size("hashes")) & (o < size) & (o >= F.length("mask") - size))
    return F.transform(inside, lambda o: F.xxhash64("seed", o, F.get("hashes", F.col(pos) + o)))


def alignments(
    rows: DataFrame, hashed: DataFrame, masks: Sequence[str], window: int, similarity: float, most_seeds: int = MOST_SEEDS, crowd: int = CROWD
) -> DataFrame:
    """(_row, item_key, shift) of ``rows(_row, hashes)`` and items ``hashed(item_key, hashes)``: every alignment on which the two may agree."""
    size = F.least(F.lit(window), F.size("hashes"))
    items = _item_seeds(hashed.filter(size >= SHORT), masks, size, similarity)
    if not hashed.filter(size < SHORT).isEmpty():
        items = items.unionByName(_item_seeds(hashed.filter(size < SHORT), SHORT_MASKS, size, similarity))
        masks = [*masks, *SHORT_MASKS]
    items = staged(items, "item-seeds")
    often = staged(items.filter("least > 0").groupBy("seed", "mask").count().filter(F.col("count") > crowd).select("seed", "mask"), "crowded-seeds")
    crowded = items.filter("least > 0").join(often.select("seed"), "seed", "left_semi")
    plain = items.filter("least <= 0").unionByName(items.filter("least > 0").join(often.select("seed"), "seed", "left_anti"))
    plain = _broadcast(staged(plain.select("item_key", "item_pos", "seed"), "plain-seeds"), most_seeds)

    doc_seeds = seeds(rows, "_row", masks)
    hits = doc_seeds.join(plain, "seed").select("_row", "item_key", (F.col("pos") - F.col("item_pos")).alias("shift"))
    if often.isEmpty():
        return hits.distinct()

    keys = crowded.join(hashed, "item_key").select("item_key", "item_pos", "seed", "least", _neighbours(masks, window, "item_pos", F.col("size")).alias("keys"))
    keys = staged(keys.filter(F.size("keys") >= F.col("least")).select("*", (F.size("keys") - F.col("least") + 1).alias("needed"), F.explode("keys").alias("key")).drop("keys"), "item-keys")
    keys = keys.join(keys.groupBy("key").agg(F.count("*").alias("uses")), "key")
    place = F.row_number().over(Window.partitionBy("item_key", "item_pos", "seed").orderBy("uses", "key"))
    keys = staged(keys.withColumn("place", place).filter("place <= needed").select("key", "item_key", "item_pos"), "rare-keys")

    at = staged(doc_seeds.join(_broadcast(often, most_seeds), "seed").select("_row", "pos", "seed", "mask").distinct(), "crowded-hits")
    near = rows.join(at, "_row").select("_row", "pos", F.explode(_neighbours(masks, window, "pos", F.lit(window))).alias("key"))
    near = near.join(_broadcast(keys, most_seeds), "key").select("_row", "item_key", (F.col("pos") - F.col("item_pos")).alias("shift"))
    return hits.unionByName(near).distinct()


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    masks: Sequence[str] = MASKS,
    window: int = WINDOW,
    similarity: float = SIMILARITY,
    most_seeds: int = MOST_SEEDS,
    crowd: int = CROWD,
) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words, n_equal): the best window of each overlapping document and item.

    Starts are word numbers from 0; of equally good windows the first in the item counts, then the first in the document.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("item")).filter(F.size("item") >= SHORTEST)
    items = staged(items.groupBy("item").agg(F.min("item_id").alias("item_id")).withColumn("item_key", F.xxhash64("item")), "items")
    hashed = items.select("item_key", F.transform("item", lambda w: F.xxhash64(w)).alias("hashes"))
    # a row is known by its content: rows without an id, or with the same one, keep their alignments apart
    row = F.xxhash64("doc_id", "text").alias("_row")
    hits = staged(alignments(docs.select(row, _hashed(F.col("text")).alias("hashes")), hashed, masks, window, similarity, most_seeds, crowd), "hits")

    found = docs.select("doc_id", row, words(F.col("text")).alias("doc")).join(hits, "_row")
    found = found.join(items, "item_key")
    # the part of the item that lies on the document, compared word by word
    first = F.greatest(F.lit(0), -F.col("shift"))
    length = F.least(F.size("item"), F.size("doc") - F.col("shift")) - first
    equal = F.zip_with(
        F.slice("item", first + 1, F.greatest(length, F.lit(0))),
        F.slice("doc", first + F.col("shift") + 1, F.greatest(length, F.lit(0))),
        lambda a, b: F.when(a == b, 1).otherwise(0),
    )
    size = F.least(F.lit(window), F.size("item"))
    rows = found.select("doc_id", "item_id", "shift", first.alias("first"), size.alias("n_words"), equal.alias("equal")).filter(F.size("equal") >= F.col("n_words"))
    starts = F.sequence(F.lit(0), F.size("equal") - F.col("n_words"))
    sums = F.transform(starts, lambda s: F.struct((F.aggregate(F.slice("equal", s + 1, F.col("n_words")), F.lit(0), lambda a, x: a + x)).alias("n_equal"), (-s).alias("s")))
    best = rows.withColumn("best", F.array_max(sums)).filter(F.col("best.n_equal") >= F.lit(similarity) * F.col("n_words"))
    item_start = F.col("first") - F.col("best.s")
    picked = best.groupBy("doc_id", "item_id").agg(
        F.max(F.struct(F.col("best.n_equal").alias("n_equal"), (-item_start).alias("i"), (-(item_start + F.col("shift"))).alias("d"), "n_words")).alias("m")
    )
    return picked.select("doc_id", "item_id", (-F.col("m.d")).alias("doc_start"), (-F.col("m.i")).alias("item_start"), "m.n_words", "m.n_equal")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap with no benchmark item."""
    leaked = overlaps(docs, benchmark).select(F.col("doc_id").alias("_dc_id")).distinct()
    return docs.join(leaked, docs["doc_id"].eqNullSafe(leaked["_dc_id"]), "left_anti")

"""Exact deduplication by heavy-hitter split.

A Misra-Gries summary (``approx_top_k``, a frequent-items sketch that merges map-side) names the digests that may be
frequent. Their rows are counted exactly and the verified winners, at most ``heavy`` rows, are broadcast: copies of a
frequent text are decided where they are read and never shuffled. All other digests take the ordinary shuffle, where no
group can be larger than the sketch's error bound (3.5 / ``tracked`` of all rows) unless ``heavy`` more frequent ones exist.
The sketch only routes rows; a digest it misses is merely shuffled, so the result is exact.

Defined cases: a null text equals the empty text. Of equal texts the row with the largest doc_id stays; null ids lose
against any id. Rows that repeat both id and text keep one row. Long texts are hashed whole. Columns other than doc_id
and text are carried untouched, whatever their names (names starting with ``_hh_`` are reserved). An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hanok.llm.tables import ascii_lower, staged

#: Counters of the sketch, and how many of its entries may be broadcast.
TRACKED, HEAVY = 4096, 256


def digest(text):
    """SHA-256 (lowercase hex) of the text in UTF-8 after lower-casing A-Z."""
    return F.sha2(ascii_lower(text), 256)


def winners(digests: DataFrame, tracked: int = TRACKED, heavy: int = HEAVY) -> DataFrame:
    """Verified winners of frequent digests: (_hh_sha, _hh_keep, _hh_size), at most ``heavy`` rows.

    ``digests`` (doc_id, _hh_sha) should be staged: it is read twice.
    """
    top = digests.agg(F.expr(f"approx_top_k(_hh_sha, {int(heavy)}, {int(tracked)})").alias("top"))
    named = top.select(F.explode("top.item").alias("_hh_sha"))
    exact = digests.join(F.broadcast(named), "_hh_sha").groupBy("_hh_sha").agg(F.max("doc_id").alias("_hh_keep"), F.count("*").alias("_hh_size"))
    return exact.filter(F.col("_hh_size") > 1)


def _split(rows: DataFrame, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows already decided as copies of a frequent text, and the rest."""
    tagged = rows.join(F.broadcast(heavy), "_hh_sha", "left")  # at most HEAVY rows
    lost = F.col("_hh_keep").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("_hh_keep"))
    return tagged.filter(lost), tagged.filter(~lost)


def group_copies(docs: DataFrame, tracked: int = TRACKED, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs(doc_id, text)``."""
    rows = staged(docs.select("doc_id", digest(F.col("text")).alias("_hh_sha")), "digests")
    lost, rest = _split(rows, winners(rows, tracked, heavy))
    same = Window.partitionBy("_hh_sha")
    out = ["doc_id", "keep_id", "group_size", "kept", F.col("_hh_sha").alias("text_sha256")]
    decided = lost.select("*", F.col("_hh_keep").alias("keep_id"), F.col("_hh_size").alias("group_size"), F.lit(False).alias("kept"))
    shuffled = rest.select(
        "*",
        F.coalesce("_hh_keep", F.max("doc_id").over(same)).alias("keep_id"),
        F.coalesce("_hh_size", F.count("*").over(same)).alias("group_size"),
        (F.row_number().over(same.orderBy(F.col("doc_id").desc_nulls_last())) == 1).alias("kept"),
    )
    return decided.select(*out).unionByName(shuffled.select(*out))


def deduplicate(docs: DataFrame, tracked: int = TRACKED, heavy: int = HEAVY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = docs.withColumn("_hh_sha", digest(F.col("text")))
    heavy_rows = winners(staged(rows.select("doc_id", "_hh_sha"), "digests"), tracked, heavy)
    _, rest = _split(rows, heavy_rows)
    first = Window.partitionBy("_hh_sha").orderBy(F.col("doc_id").desc_nulls_last())
    return rest.withColumn("_hh_rank", F.row_number().over(first)).filter("_hh_rank = 1").select(*docs.columns)

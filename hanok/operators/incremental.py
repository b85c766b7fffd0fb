"""Replacing months, keeping history, merging and comparing snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hanok.functions.months import is_due, refresh_start
from hanok.operators import guards


def replace_window(stored: DataFrame, fresh: DataFrame, start: str, end: str) -> DataFrame:
    """Stored rows outside the refreshed months, plus the fresh rows. A month filter only: no shuffle."""
    return stored.filter(~F.col("ym").between(start, end)).unionByName(fresh)


def overwrite_months(fresh: DataFrame, path: str) -> None:
    """The same on a stored table: only the month partitions present in ``fresh`` are replaced."""
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ym").parquet(path)


def append_months(fresh: DataFrame, path: str) -> None:
    """Rows beside those that the stored months have."""
    fresh.write.mode("append").partitionBy("ym").parquet(path)


IDENTITY = ("region", "legal_dong", "build_year")


def identity_conflicts(before: DataFrame, now: DataFrame, fields: Sequence[str] = IDENTITY) -> DataFrame:
    """Known complexes whose identity changed: their history may not be carried over."""
    renamed = before.select("complex_id", *[F.col(f).alias(f"_{f}") for f in fields])
    joined = now.join(renamed, "complex_id")
    out = [
        guards.violations(joined, "identity_conflict", F.col(f"_{f}").isNotNull() & ~F.col(f"_{f}").eqNullSafe(F.col(f)), "complex_id", F.lit(f))
        for f in fields
    ]
    return guards.all_of(*out)


def preserve_history(stored: DataFrame, fresh: DataFrame, complexes: DataFrame, start: str) -> DataFrame:
    """Stored rows before the refresh start of complexes that still exist, plus the fresh rows."""
    older = stored.filter(F.col("ym") < start).join(complexes.select("complex_id"), "complex_id", "left_semi")
    return older.unionByName(fresh)


def freeze_history(stored: DataFrame, fresh: DataFrame, start: str, effective: str) -> DataFrame:
    """When the source no longer offers its first years: rows from ``start`` up to the effective start stay as stored."""
    return stored.filter((F.col("ym") >= start) & (F.col("ym") < effective)).unionByName(fresh)


def backfill_new(merged: DataFrame, full_history: DataFrame, now: DataFrame, before: DataFrame) -> DataFrame:
    """Complexes that are new get their whole history in place of the rows of the refresh window."""
    new = new_ids(now, before)
    return merged.join(new, "complex_id", "left_anti").unionByName(full_history.join(new, "complex_id", "left_semi"))


def new_ids(now: DataFrame, before: DataFrame) -> DataFrame:
    return now.select("complex_id").join(before.select("complex_id"), "complex_id", "left_anti")


def with_refresh_start(meta: DataFrame) -> DataFrame:
    """``meta(provider, previous, configured, end, full, verified)`` with the first month to collect again."""
    return meta.withColumn("refresh_start", refresh_start("previous", "configured", "end", "full", "verified"))


def with_due(meta: DataFrame) -> DataFrame:
    """``meta(event, published, closed)`` with whether a run is due."""
    return meta.withColumn("due", is_due("event", "published", "closed"))


def merge_providers(*snapshots: tuple[str, DataFrame]) -> DataFrame:
    """Union of provider tables that may lack each other's columns."""
    out = None
    for provider, df in snapshots:
        part = df.withColumn("provider", F.lit(provider))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def snapshot_diff(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows added and removed between two snapshots, copies counted: one shuffle on the row.

    Equal rows are counted on the map side, so a much repeated trade is a single record in the shuffle.
    """
    both = before.select(*columns, F.lit(-1).alias("_s")).unionByName(after.select(*columns, F.lit(1).alias("_s")))
    net = both.groupBy(*columns).agg(F.sum("_s").alias("net")).filter(F.col("net") != 0)
    return net.select(*columns, F.when(F.col("net") > 0, "added").otherwise("removed").alias("change"), F.abs("net").alias("copies"))


def changed_keys(before: DataFrame, after: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys that were added, removed or changed between two snapshots with unique keys."""
    a = before.select(*key, F.struct(*columns).alias("_old"))
    b = after.select(*key, F.struct(*columns).alias("_new"))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    joined = a.join(b, list(key), "full_outer").filter(~F.col("_old").eqNullSafe(F.col("_new")))
    return joined.select(*key, kind.alias("change"))


def three_way(base: DataFrame, local: DataFrame, remote: DataFrame, key: Sequence[str], value: str = "value") -> DataFrame:
    """Merge (path, value) rows: the unchanged side yields, a double change keeps local, deletions propagate.

    The three inputs are stacked and grouped once by path instead of being joined twice.
    """
    tagged = None
    for tag, df in (("b", base), ("l", local), ("r", remote)):
        part = df.select(*key, F.lit(tag).alias("_t"), F.col(value).alias("_v"))
        tagged = part if tagged is None else tagged.unionByName(part)

    def held(tag):
        # a struct tells "absent" from "present with a null value"
        return F.max(F.when(F.col("_t") == tag, F.struct("_v")))

    g = tagged.groupBy(*key).agg(held("b").alias("b"), held("l").alias("l"), held("r").alias("r"))
    chosen = F.when(F.col("b").eqNullSafe(F.col("l")), F.col("r")).otherwise(F.col("l"))
    origin = (
        F.when(F.col("l").eqNullSafe(F.col("r")), "same")
        .when(F.col("b").eqNullSafe(F.col("l")), "remote")
        .when(F.col("b").eqNullSafe(F.col("r")), "local")
        .otherwise("both")
    )
    merged = g.withColumn("m", chosen).withColumn("origin", origin).filter(F.col("m").isNotNull())
    return merged.select(*key, F.col("m._v").alias(value), "origin")


def newest(rows: DataFrame, owner: str, order: Sequence, keep: int = 10) -> DataFrame:
    """The newest ``keep`` rows per owner; every map task already keeps no more than that per owner."""
    place = F.row_number().over(Window.partitionBy(owner).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= keep)

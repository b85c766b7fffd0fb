"""Streams of disclosed trades: month replacement, coverage counts, late cancellations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hanok.operators.incremental import append_months, overwrite_months


def month_changes(fresh: DataFrame, stored: DataFrame) -> dict[str, tuple[str, bool]]:
    """Latest run of each month of ``fresh``, and whether stored rows have to go: rows of an earlier run, or a response that
    is repeated. Both have ``ym``, ``run`` and ``response``; a row without a run is older than any. One row per month."""
    key, run = ["ym", "run", "response"], F.coalesce("run", F.lit(""))
    arrived = fresh.select(*key).filter("ym is not null").distinct()
    newest = {r.ym: r.run for r in arrived.groupBy("ym").agg(F.max(run).alias("run")).collect()}
    held = stored.filter(F.col("ym").isin(list(newest))).select(*key).distinct()
    again = arrived.join(held, key).select("ym").distinct().withColumn("again", F.lit(True))
    before = held.groupBy("ym").agg(F.min(run).alias("first"), F.max(run).alias("last")).join(again, "ym", "left")
    out = {ym: (run_, False) for ym, run_ in newest.items()}
    for r in before.collect():
        latest = max(newest[r.ym], r.last)
        out[r.ym] = latest, bool(r.again) or r.first < latest
    return out


def merge_responses(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of the months of ``fresh``: those of each month's latest ``run``, a repeated ``response`` counting as it is in
    ``fresh``."""
    again = fresh.select("ym", "run", "response").distinct()
    kept = stored.join(again, ["ym", "run", "response"], "left_anti")
    return kept.unionByName(fresh)


def _of_latest(rows: DataFrame, latest: dict[str, str]) -> DataFrame:
    """Rows of the latest run of these months."""
    months: dict[str, list[str]] = {}
    for ym, run in latest.items():
        months.setdefault(run, []).append(ym)
    run = F.coalesce("run", F.lit(""))
    return rows.filter(reduce(Column.__or__, [F.col("ym").isin(some) & (run == r) for r, some in months.items()]))


def replace_months(stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Responses of a collection run replace the months stored by earlier runs; other months stay.

    The responses of a run may arrive in any number of batches: a month grows until all of them are there, its rows written
    once, and an earlier run's rows that arrive late change nothing. ``prepare`` gives rows with ``ym``, ``run`` and ``response``; without the
    two, every batch has to hold whole months. Repeating a batch after a failure finds its responses stored and writes their
    months again, so nothing is lost or doubled.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = prepare(batch)
        if not {"run", "response"} <= set(fresh.columns):
            overwrite_months(fresh, path)
            return
        stored = fresh.sparkSession.read.schema(fresh.schema).parquet(path)
        changes = month_changes(fresh, stored)
        grown = {ym: latest for ym, (latest, replaced) in changes.items() if not replaced}
        anew = {ym: latest for ym, (latest, replaced) in changes.items() if replaced}
        if anew:
            # files of replaced months go when all tasks have written theirs, so they may be read meanwhile
            overwrite_months(merge_responses(_of_latest(fresh, anew), _of_latest(stored, anew)).repartition("ym"), path)
        if grown:
            append_months(_of_latest(fresh, grown).repartition("ym"), path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def coverage_counts(stream: DataFrame, time: str, group: str, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Rows per event-time window and group, late rows accepted up to ``delay``."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", delay)
    counts = timed.groupBy(F.window("_t", window).alias("w"), group).agg(F.count("*").alias("rows"))
    return counts.select(F.col("w.start").alias("window_start"), group, "rows")


def active_trades(stream: DataFrame, key: Sequence[str], cancelled: str = "cancelled") -> DataFrame:
    """Disclosed and cancelled rows per trade key, and the copies that are still active.

    A cancellation takes back one copy whenever it arrives, also before the trade itself. Kept as a running
    aggregate: copies of a key are added up before the shuffle and the state holds two numbers per key.
    """
    counts = stream.groupBy(*key).agg(
        F.count_if(~F.col(cancelled)).alias("disclosed"), F.count_if(F.col(cancelled)).alias("cancelled")
    )
    return counts.withColumn("active", F.greatest(F.lit(0), F.col("disclosed") - F.col("cancelled")))


def write_updates(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every changed key with its batch number; :func:`latest` reads the present state."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id:08d}")

    return (
        updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest(written: DataFrame, key: Sequence[str]) -> DataFrame:
    """Last value of every key."""
    rest = [c for c in written.columns if c not in (*key, "batch")]
    return written.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("v")).select(*key, "v.*")

"""Numbering rows of a whole table in order, without pulling the table into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hanok.session import cut

POSITION_BITS = 33  # monotonically_increasing_id: partition number above, position in the partition below


def number_rows(df: DataFrame, *order: Column, name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Add 1-based row numbers in the given order, which must be total.

    The rows are range-partitioned and sorted, written once to the checkpoint folder, and numbered there: position in
    the partition plus the row count of the partitions before it. Only one row per partition meets in a single task.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = cut(ranged.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", POSITION_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    position = F.col("_at") - F.shiftleft("_part", POSITION_BITS)
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(name, F.col("_before") + position + 1)
        .drop("_at", "_part", "_before")
    )

"""Counts and summary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def month_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Rows per month, optionally per further columns."""
    return rows.groupBy(*by, "ym").agg(F.count("*").alias("rows"))


def region_coverage(complexes: DataFrame, sales: DataFrame, leases: DataFrame) -> DataFrame:
    """Per region and in total: complexes, sale rows, lease rows, verified ratios, unresolved complexes.

    Trades are counted per complex first, so the join to the catalogue sees one row per complex.
    """
    s = sales.groupBy("complex_id").agg(F.count("*").alias("sale_rows"))
    r = leases.groupBy("complex_id").agg(F.count("*").alias("lease_rows"))
    joined = complexes.join(s, "complex_id", "left").join(r, "complex_id", "left")
    return joined.rollup("region").agg(
        F.count("*").alias("complexes"),
        F.coalesce(F.sum("sale_rows"), F.lit(0)).alias("sale_rows"),
        F.coalesce(F.sum("lease_rows"), F.lit(0)).alias("lease_rows"),
        F.count_if(F.col("far_status") == "verified").alias("far_verified"),
        F.count_if(F.col("data_status") == "matching_unconfirmed").alias("unresolved"),
    )


def part_stats(parts: DataFrame) -> DataFrame:
    """Totals and month range over region parts."""
    return parts.agg(
        F.count("*").alias("parts"), F.min("min_month").alias("min_month"), F.max("current_month").alias("current_month"),
        F.sum("complex_count").alias("complexes"), F.sum("transaction_count").alias("transactions"),
    )


def top_floors(complexes: DataFrame, sales: DataFrame) -> DataFrame:
    """Top floor per complex: of the catalogue, else the highest one seen in a trade."""
    seen = sales.groupBy("complex_id").agg(F.max("floor").alias("observed_top"))
    out = complexes.join(seen, "complex_id", "left")
    if "top_floor" in complexes.columns:
        return out.withColumn("top_floor", F.coalesce("top_floor", "observed_top"))
    return out.withColumn("top_floor", F.col("observed_top"))


def status_histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def attribute_conflicts(rows: DataFrame, key: str, facts) -> DataFrame:
    """Keys whose rows disagree on the given facts. Smallest and largest tuple tell it without a distinct count."""
    packed = F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in facts])
    return rows.groupBy(key).agg(F.count("*").alias("rows"), (F.min(packed) != F.max(packed)).alias("conflict"))

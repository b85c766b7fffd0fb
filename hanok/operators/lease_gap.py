"""Deposit reference of a complex at the start month, and the gap between sale estimate and deposit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanok.functions.months import month_index, month_name
from hanok.operators.coverage import top_floors


def middle_floor_sales(sales: DataFrame, complexes: DataFrame, lowest: int = 4) -> DataFrame:
    """Sales without the lowest three floors and the top floor (of the catalogue, else the highest seen)."""
    tops = top_floors(complexes, sales).select("complex_id", "top_floor")
    return sales.join(tops, "complex_id").filter((F.col("floor") >= lowest) & (F.col("floor") < F.col("top_floor"))).drop("top_floor")


def widened_type(sales: DataFrame, kind: int = 59) -> DataFrame:
    """Trades of a type per complex: the narrow band or, where that is empty, the one area of the 45 to 75 band that is
    nearest to 59 (the smaller of two)."""
    low, high = {59: (57.0, 61.5), 84: (82.0, 86.5)}[kind]
    narrow = F.col("area").between(low, high)
    if kind != 59:
        return sales.filter(narrow).withColumn("substitute", F.lit(False))
    wide = sales.filter((F.col("area") >= 45) & (F.col("area") < 75))
    has = wide.groupBy("complex_id").agg(F.max(narrow).alias("_has"), F.min(F.struct(F.abs(F.col("area") - 59), "area"))["area"].alias("_nearest"))
    chosen = narrow | (~F.col("_has") & (F.col("area") == F.col("_nearest")))
    return wide.join(has, "complex_id").filter(chosen).withColumn("substitute", ~F.col("_has")).drop("_has", "_nearest")


def lease_reference(
    estimates: DataFrame,
    leases: DataFrame,
    tops: DataFrame,
    start_month: str,
    lookback: int = 12,
    kinds=("신규",),
    tolerance: float = 0.1,
    lowest: int = 4,
) -> DataFrame:
    """Highest deposit per complex: same area within the tolerance, start month and ``lookback`` months before.

    ``estimates(complex_id, area_used)`` is the start side. ``kinds=None`` takes every contract. The month filter is on
    the partition column; the top floor and unknown floors do not count. Areas are compared as decimals.
    """
    first, last = month_name(month_index(start_month) - lookback), start_month
    pool = leases.filter(F.col("ym").between(first, last) & (F.col("floor") >= lowest))
    if kinds is not None:
        pool = pool.filter(F.col("kind").isin(*kinds))
    wanted = estimates.select("complex_id", F.col("area_used").cast("decimal(9,3)").alias("_area"))
    hit = (
        pool.join(wanted, "complex_id")
        .filter(F.abs(F.col("area").cast("decimal(9,3)") - F.col("_area")) <= F.lit(str(tolerance)).cast("decimal(9,3)"))
        .join(tops.select("complex_id", "top_floor"), "complex_id", "left")
        .filter(F.col("top_floor").isNull() | (F.col("floor") < F.col("top_floor")))
    )
    return hit.groupBy("complex_id").agg(
        F.max(F.struct("deposit", "date", "floor", "area")).alias("m"), F.count("*").alias("lease_rows")
    ).select("complex_id", F.col("m.deposit").alias("deposit"), F.col("m.date").alias("lease_date"), F.col("m.floor").alias("lease_floor"), "lease_rows")


def gaps(start_estimates: DataFrame, reference: DataFrame, most_months: int = 3) -> DataFrame:
    """Start sale estimate minus deposit; no gap when the estimate had to look further than ``most_months``."""
    joined = start_estimates.join(reference, "complex_id", "left")
    return joined.withColumn("gap", F.when(F.col("window") <= most_months, F.col("value") - F.col("deposit")))

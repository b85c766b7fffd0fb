"""Price comparison of complexes between two months: the main report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanok.functions.months import month_index
from hanok.operators import guards
from hanok.operators.estimate import area_clusters, confidence, eligible_complexes, estimates, typed_trades
from hanok.operators.ranking import number_rows


def sides(from_month: str, to_month: str) -> dict[str, tuple[int, bool]]:
    """The start month may look both ways; the end month knows no later trades."""
    return {"start": (month_index(from_month), False), "end": (month_index(to_month), True)}


def side_structs(est: DataFrame, *keys: str) -> DataFrame:
    """One row per key with the start and the end estimate as structs."""
    fields = [c for c in est.columns if c not in (*keys, "side")]
    packed = F.struct(*fields)
    return est.groupBy(*keys).agg(
        F.max(F.when(F.col("side") == "start", packed)).alias("start"),
        F.max(F.when(F.col("side") == "end", packed)).alias("end"),
    )


def compare(complexes: DataFrame, sales: DataFrame, from_month: str, to_month: str, kind: int = 59, meta: DataFrame | None = None, **filters) -> DataFrame:
    """Unranked comparison: every eligible complex with both estimates, change, rate, grade and reasons.

    With ``meta(provider, current_month)`` a comparison that ends in a month which a provider has yet to collect has no
    rows: older prices must not pass for those of that month.
    """
    from hanok.functions import fixed_values as fv

    bands = {kind: fv.ANALYSIS_BANDS[kind]}
    est = estimates(sales, sides(from_month, to_month), bands)
    both = side_structs(est.drop("area_type"), "complex_id")
    grade, reasons = confidence()
    has_area = area_clusters(typed_trades(sales, bands)).filter("place = 1").select("complex_id", F.lit(True).alias("has_area"))
    if meta is not None and not guards.period_pending(meta, to_month).isEmpty():
        complexes = complexes.limit(0)
    df = eligible_complexes(complexes, **filters).join(both, "complex_id", "left").join(has_area, "complex_id", "left")
    df = df.withColumn("change", F.col("end.value") - F.col("start.value"))
    df = df.withColumn("rate", F.col("change") / F.col("start.value") * 100)
    missing = F.when(F.col("change").isNull(), F.when(F.col("has_area"), "no_trades_in_period").otherwise("no_trades_of_type"))
    return df.withColumn("missing", missing).withColumn("confidence", grade).withColumn("reasons", reasons).drop("has_area")


def ranked(compared: DataFrame, collation: str | None = "ko") -> DataFrame:
    """Rank by change, then rate, then name; complexes without a change are listed after, unranked, by name."""
    name = F.collate("name", collation) if collation else F.col("name")
    order = [F.col("change").desc_nulls_last(), F.col("rate").desc_nulls_last(), name.asc(), F.col("complex_id").asc()]
    return number_rows(compared, *order, name="line").withColumn("rank", F.when(F.col("change").isNotNull(), F.col("line")))


def report_columns(df: DataFrame) -> DataFrame:
    def side(prefix):
        return [
            F.col(f"{prefix}.value").alias(f"{prefix}_value"),
            F.col(f"{prefix}.low").alias(f"{prefix}_low"),
            F.col(f"{prefix}.high").alias(f"{prefix}_high"),
            F.col(f"{prefix}.samples").cast("bigint").alias(f"{prefix}_samples"),
            F.col(f"{prefix}.window").cast("bigint").alias(f"{prefix}_window"),
            F.col(f"{prefix}.outliers").cast("bigint").alias(f"{prefix}_outliers"),
            F.col(f"{prefix}.area_used").cast("double").alias(f"{prefix}_area"),
            F.col(f"{prefix}.primary_area").cast("double").alias(f"{prefix}_primary_area"),
        ]

    return df.select(
        F.col("rank").cast("bigint").alias("rank"), F.col("line").cast("bigint").alias("line"),
        "complex_id", "name", "region", *side("start"), *side("end"),
        "change", "rate", F.col("confidence").cast("bigint").alias("confidence"), "missing",
        F.concat_ws(" / ", "reasons").alias("reasons"),
    )

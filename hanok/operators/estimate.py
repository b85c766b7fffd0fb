"""Representative prices: area clusters, robust outlier filter, adaptive time window, weighted median.

The trades of a type are first counted per (complex, area, month, price). Everything after that works on those
counts with ``percentile(value, p, frequency)``, so a complex that holds a large share of all trades is reduced on
the map side and never travels row by row. One more shuffle on (complex, type, area, side) serves all the rest:
context statistics, deviation, window choice and the final aggregates share its partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hanok.functions import fixed_values as fv
from hanok.functions.months import month_name
from hanok.functions.values import weight_twentieths

CONTEXT_MONTHS = 3


def area_type(area, bands: Mapping[int, tuple[float, float]]) -> Column:
    out = None
    for kind, (low, high) in bands.items():
        cond = F.col(area).between(low, high)
        out = F.when(cond, F.lit(kind)) if out is None else out.when(cond, F.lit(kind))
    return out


def typed_trades(sales: DataFrame, bands=fv.ANALYSIS_BANDS, min_floor: int | None = 10) -> DataFrame:
    """Trades of the wanted types on middle floors, with ``area_type`` and the cluster area to two decimals."""
    df = sales.withColumn("area_type", area_type("area", bands)).filter(F.col("area_type").isNotNull())
    if min_floor is not None:
        df = df.filter(F.col("floor") >= min_floor)
    return df.withColumn("cluster_area", F.round(F.col("area").cast("decimal(9,3)"), 2).cast("decimal(9,2)"))


def area_clusters(typed: DataFrame) -> DataFrame:
    """Exact areas of a complex and type with trade counts; ``place`` 1 is the representative one."""
    counts = typed.groupBy("complex_id", "area_type", "cluster_area").agg(F.count("*").alias("trades"))
    off = F.abs(F.col("cluster_area") - F.col("area_type"))
    by_count = Window.partitionBy("complex_id", "area_type").orderBy(F.desc("trades"), off, "cluster_area")
    ranked = counts.withColumn("_n", F.row_number().over(by_count)).withColumn(
        "primary_area", F.first("cluster_area").over(by_count)
    )
    off_primary = F.abs(F.col("cluster_area") - F.col("primary_area"))
    by_closeness = Window.partitionBy("complex_id", "area_type").orderBy(
        F.when(F.col("_n") == 1, 0).otherwise(1), off_primary, F.desc("trades"), "_n"
    )
    return ranked.withColumn("place", F.row_number().over(by_closeness)).drop("_n")


def price_counts(typed: DataFrame, targets: Mapping[str, tuple[int, bool]]) -> DataFrame:
    """Trades per (complex, type, area, month, price), only months that some target can use, one copy per target.

    ``targets`` maps a side name to (month index, whether later months are unknown to it).
    """
    reach = max(fv.WINDOWS)
    near = F.lit(False)
    for index, no_future in targets.values():
        # on the month text, so that a table partitioned by month is pruned
        near = near | F.col("ym").between(month_name(index - reach), month_name(index if no_future else index + reach))
    counts = (
        typed.filter(near)
        .groupBy("complex_id", "area_type", "cluster_area", "midx", "price")
        .agg(F.count("*").alias("n"))
    )
    sides = F.array(
        *[
            F.struct(F.lit(side).alias("side"), F.lit(index).alias("target"), F.lit(no_future).alias("no_future"))
            for side, (index, no_future) in targets.items()
        ]
    )
    gap = F.col("midx") - F.col("s.target")
    return (
        counts.withColumn("s", F.explode(sides))
        .filter((F.abs(gap) <= reach) & ~(F.col("s.no_future") & (gap > 0)))
        .select("complex_id", "area_type", "cluster_area", "s.side", "price", "n", F.abs(gap).alias("distance"))
    )


def series_estimates(counts: DataFrame) -> DataFrame:
    """One robust estimate per (complex, type, area, side); series without an acceptable window are absent."""
    keys = ["complex_id", "area_type", "cluster_area", "side"]
    group = Window.partitionBy(*keys)
    in_context = F.col("distance") <= CONTEXT_MONTHS

    def share(cond):
        return F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0))).over(group)

    df = counts.withColumn("context", share(in_context)).withColumn(
        "center", F.percentile(F.when(in_context, F.col("price")), F.lit(0.5), F.col("n")).over(group)
    )
    deviation = F.abs(F.col("price") - F.col("center"))
    df = df.withColumn("mad", F.percentile(F.when(in_context, deviation), F.lit(0.5), F.col("n")).over(group))
    band = F.greatest(F.col("center") * 0.20, F.col("mad") * 1.4826 * 3, F.lit(10000.0))
    validated = F.col("context") >= 3
    df = df.withColumn("threshold", F.when(validated, band)).withColumn(
        "normal", F.when(validated, deviation <= band).otherwise(F.lit(True))
    )

    chosen = None
    for w in fv.WINDOWS:
        kept = share((F.col("distance") <= w) & F.col("normal"))
        if w == 0:
            ok = (kept >= 2) | ((kept == 1) & validated)
        elif w < max(fv.WINDOWS):
            ok = kept >= 2
        else:
            ok = kept >= 1
        chosen = F.when(ok, F.lit(w)) if chosen is None else chosen.when(ok, F.lit(w))
    df = df.withColumn("window", chosen)

    inside = df.filter(F.col("distance") <= F.col("window"))
    used = F.when(F.col("normal"), F.col("price"))
    out = inside.groupBy(*keys).agg(
        F.first("window").alias("window"),
        F.percentile(used, F.lit(0.5), F.col("n") * weight_twentieths("distance")).alias("value"),
        F.percentile(used, F.array(F.lit(0.25), F.lit(0.75)), F.col("n")).alias("_q"),
        F.sum(F.when(F.col("normal"), F.col("n")).otherwise(0)).alias("samples"),
        F.sum(F.when(F.col("normal"), F.lit(0)).otherwise(F.col("n"))).alias("outliers"),
        F.first("center").alias("center"),
        F.first("threshold").alias("threshold"),
    )
    return out.withColumn("low", F.get("_q", 0)).withColumn("high", F.get("_q", 1)).drop("_q")


def estimates(sales: DataFrame, targets: Mapping[str, tuple[int, bool]], bands=fv.ANALYSIS_BANDS, min_floor=10) -> DataFrame:
    """Estimate per (complex, type, side): the representative area, or the nearest other area that has one."""
    typed = typed_trades(sales, bands, min_floor)
    clusters = area_clusters(typed).select("complex_id", "area_type", "cluster_area", "primary_area", "place")
    series = series_estimates(price_counts(typed, targets))
    fields = ["value", "low", "high", "samples", "window", "outliers", "center", "threshold", "cluster_area", "primary_area", "place"]
    best = (
        series.join(clusters, ["complex_id", "area_type", "cluster_area"])
        .groupBy("complex_id", "area_type", "side")
        .agg(F.min_by(F.struct(*fields), "place").alias("e"))
    )
    return best.select(
        "complex_id", "area_type", "side",
        "e.value", "e.low", "e.high", "e.samples", "e.window", "e.outliers", "e.center", "e.threshold",
        F.col("e.cluster_area").alias("area_used"),
        "e.primary_area",
        (F.col("e.place") > 1).alias("area_fallback"),
    )


def evidence(sales: DataFrame, est: DataFrame, targets: Mapping[str, tuple[int, bool]], bands=fv.ANALYSIS_BANDS, min_floor=10) -> DataFrame:
    """The trades behind each estimate, with month distance and sort place within the estimate: newest first, then
    the dearest, then by floor and area."""
    typed = typed_trades(sales, bands, min_floor)
    sides = est.select("complex_id", "area_type", F.col("area_used").alias("cluster_area"), "side", "window", "center", "threshold")
    out = None
    for side, (index, no_future) in targets.items():
        near = typed.filter(F.col("ym").between(month_name(index - 12), month_name(index if no_future else index + 12)))
        hit = near.join(sides.filter(F.col("side") == side), ["complex_id", "area_type", "cluster_area"])
        hit = hit.withColumn("distance", F.abs(F.col("midx") - index)).filter(F.col("distance") <= F.col("window"))
        hit = hit.filter(F.col("threshold").isNull() | (F.abs(F.col("price") - F.col("center")) <= F.col("threshold")))
        out = hit if out is None else out.unionByName(hit)
    newest = Window.partitionBy("complex_id", "area_type", "side").orderBy(F.desc("date"), F.desc("price"), "floor", "area")
    return out.select("complex_id", "area_type", "side", "date", "floor", "area", "price", "distance", F.row_number().over(newest).alias("place"))


def confidence(start: str = "start", end: str = "end", labels: Mapping[str, str] = fv.SIDE_LABEL) -> tuple[Column, Column]:
    """Grade 1..5 and its reasons, from two struct columns holding an estimate each."""
    reasons: list[Column] = []
    penalty = F.lit(0)

    def two(c):
        return F.format_number(c.cast("decimal(9,2)"), 2)

    for side in (start, end):
        e, label = F.col(side), F.lit(labels[side])
        fallback, window, samples, outliers = e["area_fallback"], e["window"], e["samples"], e["outliers"]
        window_cost = F.when(window == 0, 0).when(window <= 1, 1).when(window <= 3, 2).otherwise(3)
        penalty = (
            penalty
            + F.when(fallback, 1).otherwise(0)
            + window_cost
            + F.when(samples <= 2, 1).otherwise(0)
            + F.when(outliers > 0, 1).otherwise(0)
        )
        reasons += [
            F.when(fallback, F.format_string(fv.REASON_AREA_FALLBACK, label, two(e["primary_area"]), two(e["area_used"])))
            .otherwise(F.format_string(fv.REASON_AREA, label, two(e["primary_area"]))),
            F.when(fallback, F.format_string(fv.REASON_FALLBACK, label)),
            F.when(window == 0, F.format_string(fv.REASON_EXACT, label)).otherwise(F.format_string(fv.REASON_WINDOW, label, window)),
            F.when(samples <= 2, F.format_string(fv.REASON_SAMPLES, label, samples)),
            F.when(outliers > 0, F.format_string(fv.REASON_OUTLIERS, label, outliers)),
        ]
    both = F.col(start).isNotNull() & F.col(end).isNotNull()
    grade = F.when(both, F.greatest(F.lit(1), F.lit(5) - penalty)).otherwise(F.lit(1))
    texts = F.when(both, F.array_compact(F.array(*reasons))).otherwise(F.array(F.lit(fv.REASON_NO_ESTIMATE)))
    return grade.cast("int"), texts


def eligible_complexes(
    complexes: DataFrame,
    regions: Sequence[str] | None = None,
    households=(300, None),
    far=(100, None),
    year=(None, None),
) -> DataFrame:
    """Complex filter. A missing ratio or year passes only under the default range of that filter."""
    from hanok.functions.values import in_range, year_of

    df = complexes if regions is None else complexes.filter(F.col("region").isin(*regions))
    df = df.filter(in_range("households", *households))
    built = year_of("completed")
    far_ok = F.when(F.col("far").isNull(), F.lit(tuple(far) == (100, None))).otherwise(in_range("far", *far))
    year_ok = F.when(built.isNull(), F.lit(tuple(year) == (None, None))).otherwise(in_range(built, *year))
    return df.filter(far_ok & year_ok)

"""Data-quality rules. Each returns rows ``(guard, key, detail)``; a run may publish only when all are empty."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hanok.functions.months import months_between_inclusive


class GuardError(Exception):
    """A data-quality rule is broken; nothing may be published."""


def violations(df: DataFrame, guard: str, broken: Column, key, detail=None) -> DataFrame:
    """Rows for which ``broken`` is true (unknown counts as broken)."""
    detail = F.lit(None) if detail is None else detail
    as_text = [F.coalesce(c.cast("string"), F.lit("")) for c in (F.col(key) if isinstance(key, str) else key, detail)]
    return df.filter(F.coalesce(broken, F.lit(True))).select(
        F.lit(guard).alias("guard"), as_text[0].alias("key"), as_text[1].alias("detail")
    )


def all_of(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def enforce(*frames: DataFrame, shown: int = 20) -> None:
    """Fail the run when any rule is broken. Only a few rows reach the driver, for the message."""
    if not frames:
        return
    found = all_of(*frames).limit(shown).collect()
    if found:
        raise GuardError("; ".join(f"{r.guard}: {r.key} {r.detail}".strip() for r in found))


def minimum_rows(df: DataFrame, least: int, guard: str = "too_few_rows") -> DataFrame:
    return violations(df.agg(F.count("*").alias("n")), guard, F.col("n") < least, F.lit("all"), F.col("n"))


def minimum_rows_by(df: DataFrame, by: str, floors: DataFrame, guard: str = "too_few_rows") -> DataFrame:
    """``floors(by, least)`` lists every expected group, so that an absent one is found too."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    joined = floors.join(counts, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return violations(joined, guard, F.col("n") < F.col("least"), by, F.col("n"))


def outside_scope(df: DataFrame, column: str, allowed: DataFrame, guard: str = "outside_scope") -> DataFrame:
    """Values that are not in ``allowed(column)``, with row counts."""
    seen = df.groupBy(column).agg(F.count("*").alias("n"))
    return violations(seen.join(allowed, column, "left_anti"), guard, F.lit(True), column, F.col("n"))


def outside_plan(rows: DataFrame, plan: DataFrame, request: Sequence[str], guard: str = "request_without_plan") -> DataFrame:
    """Requests whose rows arrived though the plan does not hold them, with row counts."""
    seen = rows.groupBy(*request).agg(F.count("*").alias("n"))
    return violations(seen.join(plan.select(*request).distinct(), list(request), "left_anti"), guard, F.lit(True), F.concat_ws("/", *request), F.col("n"))


def missing_months(df: DataFrame, by: str, groups: DataFrame, start: str, end: str, guard: str = "missing_month") -> DataFrame:
    """Every (group, month) of the range needs at least one row; ``df`` has ``by`` and ``ym``."""
    months = months_between_inclusive(F.lit(start), F.lit(end))
    expected = groups.select(by, F.explode(months).alias("ym"))
    have = df.filter(F.col("ym").between(start, end)).select(by, "ym").distinct()
    return violations(expected.join(have, [by, "ym"], "left_anti"), guard, F.lit(True), by, F.col("ym"))


def collapsed(before: DataFrame, after: DataFrame, key: str, start: str, end: str, least: int = 10, share: float = 0.5, guard: str = "trades_collapsed") -> DataFrame:
    """Keys with at least ``least`` earlier rows in the window that now keep less than ``share`` of them."""

    def count(df, name):
        return df.filter(F.col("ym").between(start, end)).groupBy(key).agg(F.count("*").alias(name))

    joined = count(before, "before").filter(F.col("before") >= least).join(count(after, "after"), key, "left")
    now = F.coalesce(F.col("after"), F.lit(0))
    return violations(joined, guard, now < F.col("before") * share, key, F.concat_ws("->", F.col("before"), now))


def shrunk(prior: DataFrame, now: DataFrame, by: str, floors: DataFrame, share: float = 0.8, guard: str = "catalogue_shrunk") -> DataFrame:
    """Per group: at least max(configured floor, whole part of ``share`` of the prior count)."""
    p = prior.groupBy(by).agg(F.count("*").alias("prior"))
    n = now.groupBy(by).agg(F.count("*").alias("n"))
    joined = floors.join(p, by, "left").join(n, by, "left").fillna(0, ["prior", "n"])
    floor = F.greatest(F.col("least"), F.floor(F.col("prior") * share))
    return violations(joined, guard, F.col("n") < floor, by, F.concat_ws("<", F.col("n"), floor))


def duplicated(df: DataFrame, keys: Sequence[str], guard: str = "duplicate_key") -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return violations(counts, guard, F.col("n") > 1, F.concat_ws("|", *keys), F.col("n"))


def region_mismatch(linked: DataFrame, complexes: DataFrame, guard: str = "region_mismatch") -> DataFrame:
    """Linked trades whose region is not the region of their complex, counted per pair first."""
    pairs = linked.groupBy("complex_id", "region").agg(F.count("*").alias("n"))
    home = complexes.select("complex_id", F.col("region").alias("_home"))
    joined = pairs.join(home, "complex_id")
    return violations(joined, guard, ~F.col("region").eqNullSafe(F.col("_home")), "complex_id", F.concat_ws("/", "region", "_home", "n"))


def nothing_linked(linked: DataFrame, by: str, groups: DataFrame, guard: str = "nothing_linked") -> DataFrame:
    return violations(groups.join(linked.select(by).distinct(), by, "left_anti"), guard, F.lit(True), by)


def invalid_complexes(complexes: DataFrame, regions: DataFrame, least_households: int, guard: str = "invalid_complex") -> DataFrame:
    known = complexes.join(regions.select("region", F.lit(True).alias("_known")), "region", "left")
    broken = F.col("_known").isNull() | F.coalesce(F.col("households") < least_households, F.lit(True))
    return violations(known, guard, broken, "complex_id", F.concat_ws("/", "region", "households"))


def number_out_of_range(price: str = "price", floor_required: bool = True) -> Column:
    """A trade's numbers must be finite and inside the accepted domain."""
    area_ok = (F.col("area") > 0) & (F.col("area") < 2000)
    floor_ok = F.col("floor").between(-10, 200)
    if not floor_required:
        floor_ok = F.col("floor").isNull() | floor_ok
    return ~F.coalesce((F.col(price) > 0) & area_ok & floor_ok, F.lit(False))


def invalid_trades(trades: DataFrame, price: str = "price", floor_required: bool = True, guard: str = "invalid_trade") -> DataFrame:
    broken = F.col("date").isNull() | number_out_of_range(price, floor_required)
    return violations(trades, guard, broken, "complex_id", F.concat_ws("/", "date", "area", "floor", price))


def totals_differ(spark: SparkSession, stated: Mapping[str, int], counted: DataFrame, guard: str = "total_differs") -> DataFrame:
    """``counted(name, n)`` against stated totals."""
    said = spark.createDataFrame([(k, int(v)) for k, v in stated.items()], "name string, stated bigint")
    joined = said.join(counted, "name", "full_outer")
    return violations(joined, guard, ~F.col("stated").eqNullSafe(F.col("n")), "name", F.concat_ws("<>", "stated", "n"))


def ratio_status(complexes: DataFrame, guard: str = "ratio_status") -> DataFrame:
    """A verified ratio is a number in (0, 2000]; any other status shows none."""
    verified = F.col("far_status") == "verified"
    sound = F.when(verified, (F.col("far") > 0) & (F.col("far") <= 2000)).otherwise(F.col("far").isNull())
    return violations(complexes, guard, ~sound, "complex_id", F.concat_ws("/", "far_status", "far"))


def lease_shape(leases: DataFrame, start: str, end: str, guard: str = "lease_shape") -> DataFrame:
    whole = F.col("floor").isNull() | F.col("floor").between(-10, 200)
    sound = F.col("ym").between(start, end) & (F.col("area") > 0) & (F.col("area") < 2000) & (F.col("deposit") > 0) & whole
    return violations(leases, guard, ~sound, "complex_id", F.concat_ws("/", "ym", "area", "deposit", "floor"))


def parts_incomplete(parts: DataFrame, expected: DataFrame, guard: str = "region_part") -> DataFrame:
    """Legacy region parts: every expected region once, all requested months fetched."""
    counts = parts.groupBy("region").agg(
        F.count("*").alias("n"), F.max(F.col("months_requested") != F.col("months_succeeded")).alias("partial")
    )
    joined = expected.select("region", F.lit(True).alias("_wanted")).join(counts, "region", "full_outer")
    broken = F.col("_wanted").isNull() | F.col("n").isNull() | (F.col("n") != 1) | F.col("partial")
    return violations(joined, guard, broken, "region", F.coalesce(F.col("n"), F.lit(0)))


def walk_out_of_range(walks: DataFrame, limit: int = 1300, most_minutes: int = 20, guard: str = "walk_out_of_range") -> DataFrame:
    sound = (F.col("distance_m") > 0) & (F.col("distance_m") <= limit) & (F.col("minutes") > 0) & (F.col("minutes") <= most_minutes)
    sound = sound & (F.size("lines") > 0) & (F.col("station") != "")
    return violations(walks, guard, ~sound, "complex_id", F.concat_ws("/", "station", "distance_m", "minutes"))


def absent(expected: DataFrame, present: DataFrame, key: str, guard: str = "absent") -> DataFrame:
    return violations(expected.select(key).join(present.select(key).distinct(), key, "left_anti"), guard, F.lit(True), key)


def linked_share(prior: DataFrame, now: DataFrame, key: str, share: float = 0.85, guard: str = "linked_share") -> DataFrame:
    """The number of linked keys may not fall below ``share`` of the prior number, if there was any."""
    a = prior.agg(F.count_distinct(key).alias("prior"), F.lit(1).alias("_one"))
    b = now.agg(F.count_distinct(key).alias("n"), F.lit(1).alias("_one"))
    joined = a.join(b, "_one")
    return violations(joined, guard, (F.col("prior") > 0) & (F.col("n") < F.col("prior") * share), F.lit("all"), F.concat_ws("->", "prior", "n"))


def response_mismatch(rows: DataFrame, guard: str = "response_mismatch") -> DataFrame:
    """Portal rows whose district, dong or year is not the one that was asked for.

    Needs ``id_district, id_dong`` (from the parcel id), ``code, dong_code, year`` (of the request), ``date``, and
    ``eup_scope``: within an eup only the first three digits of the dong have to agree.
    """
    same_dong = (F.col("id_dong") == F.col("dong_code")) | (
        F.col("eup_scope") & (F.substring("id_dong", 1, 3) == F.substring("dong_code", 1, 3))
    )
    year_ok = F.col("date").isNull() | (F.year("date") == F.col("year"))
    sound = (F.col("id_district") == F.col("code")) & same_dong & year_ok
    return violations(rows, guard, ~sound, F.concat_ws("/", "code", "dong_code", "year"), F.concat_ws("/", "id_district", "id_dong", "date"))


def ledger_coverage(ledger: DataFrame, district: str, far: DataFrame, verified_before: bool, least: int = 100) -> DataFrame:
    """Enough ledger rows of the district, and at least one verified ratio if there was one before."""
    rows = minimum_rows(ledger.filter(F.col("district") == district), least, "ledger_rows")
    n = far.agg(F.count_if(F.col("far_status") == "verified").alias("n"))
    return all_of(rows, violations(n, "no_verified_ratio", F.lit(verified_before) & (F.col("n") == 0), F.lit(district), F.col("n")))


def small_sources(files: DataFrame, least_bytes: int, guard: str = "source_too_small") -> DataFrame:
    """``files(path, length)`` as read by the binary file source."""
    return violations(files, guard, F.col("length") < least_bytes, "path", F.col("length"))


def period_pending(meta: DataFrame, wanted_month: str, guard: str = "period_pending") -> DataFrame:
    """A comparison may not run for a month that is not collected yet; ``meta(provider, current_month)``."""
    return violations(meta, guard, F.lit(wanted_month) > F.col("current_month"), "provider", F.col("current_month"))


def not_fresh(meta: DataFrame, target_month: str, guard: str = "not_fresh") -> DataFrame:
    return violations(meta, guard, ~F.col("current_month").eqNullSafe(F.lit(target_month)), "provider", F.col("current_month"))

"""Linking official sales and leases to complexes by strict keys.

The distinct keys of the trades meet the catalogue through lookups with one row per key, and the outcome is joined back
by one equi-join, which adaptive execution broadcasts where it is small and splits at hot keys where not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanok.functions import fixed_values as fv
from hanok.functions.months import let, ym_of_date
from hanok.functions.parcels import parcel
from hanok.functions.text import clean, norm
from hanok.functions.values import compact_date, integer, number
from hanok.operators import guards

KEY = ["region", "legal_dong", "parcel", "trade_name", "build_year"]


def key_columns(raw: DataFrame) -> DataFrame:
    """Add the five key columns to raw export rows; a blank building year counts as 0, a bad parcel or year is null."""
    year = F.when(F.lower(clean("arch_yr")).isin("", "null", "none"), F.lit(0)).otherwise(integer("arch_yr"))
    return (
        raw.withColumn("legal_dong", clean("stdg_nm"))
        .withColumn("parcel", parcel("mno", "sno"))
        .withColumn("trade_name", norm(clean("bldg_nm")))
        .withColumn("build_year", year.cast("int"))
    )


def sale_rows(raw: DataFrame, districts: DataFrame) -> DataFrame:
    """Typed sale rows with ``excluded``: the first reason, in source order, for which a row does not count.

    ``districts(cgg_cd, region)`` is the configured list. Numbers are null where the text is bad; whether that matters
    is decided by the guards, for linked rows only.
    """
    df = key_columns(raw.withColumn("cgg_cd", clean("cgg_cd"))).join(districts, "cgg_cd", "left")
    excluded = F.when(clean("bldg_usg") != fv.APARTMENT, "non_apartment").when(
        ~clean("rght_se").isin("", fv.OWNERSHIP), "rights_excluded"
    )
    date = compact_date("ctrt_day")
    return df.select(
        *KEY, "cgg_cd", clean("rcpt_yr").alias("receipt_year"), F.trim("bldg_nm").alias("building"),
        date.alias("date"), ym_of_date(date).alias("ym"),
        number("arch_area").alias("area"), integer("flr").cast("int").alias("floor"), integer("thing_amt").alias("price"),
        (~clean("rtrcn_day").isin("", "-", "0")).alias("cancelled"), excluded.alias("excluded"),
    )


def binding_map(bindings: DataFrame, complexes: DataFrame) -> DataFrame:
    """Key to complex, from the binding list restricted to the catalogue."""
    home = complexes.select("complex_id", "region")
    return (
        bindings.join(home, "complex_id")
        .select(*[F.col(c) for c in ("region", "legal_dong")], F.col("jibun").alias("parcel"), norm("trade_name").alias("trade_name"), "build_year", "complex_id")
        .distinct()
    )


def binding_conflicts(bindings: DataFrame, complexes: DataFrame) -> DataFrame:
    """Bindings that contradict the catalogue (dong, or more than two years apart) or each other."""
    c = complexes.select("complex_id", F.col("legal_dong").alias("_dong"), F.coalesce("build_year", F.lit(0)).alias("_year"))
    joined = bindings.join(c, "complex_id")
    drift = ~F.col("legal_dong").eqNullSafe(F.col("_dong")) | (F.abs(F.col("_year") - F.col("build_year")) > 2)
    stale = guards.violations(joined, "binding_conflict", drift, "complex_id", F.concat_ws("/", "legal_dong", "build_year"))
    return guards.all_of(stale, guards.duplicated(binding_map(bindings, complexes), KEY, "binding_duplicate"))


def name_index(complexes: DataFrame, aliases: bool = True) -> DataFrame:
    """Every (region, dong, year, normalised name) that belongs to exactly one complex."""
    names = [norm("name"), norm("official_name")]
    known = F.array_distinct(F.concat(F.array(*names), F.coalesce(F.transform("aliases", lambda a: norm(a)), F.array().cast("array<string>")))) if aliases else F.array_distinct(F.array(*names))
    exploded = complexes.select("region", "legal_dong", "build_year", "complex_id", F.explode(known).alias("trade_name"))
    return (
        exploded.groupBy("region", "legal_dong", "build_year", "trade_name")
        .agg(F.min("complex_id").alias("complex_id"), F.max("complex_id").alias("_other"))
        .filter(F.col("complex_id") == F.col("_other"))
        .drop("_other")
    )


def resolve(rows: DataFrame, bindings: DataFrame, complexes: DataFrame, mode: str = "sale") -> DataFrame:
    """Add ``complex_id`` and ``method``: the binding list first, then one exact name whose parcel is known.

    ``mode="lease"`` uses name and official name only, and the parcel must be in the binding list; for sales, aliases
    and the catalogue's own parcel count too. Every lookup has one row per key, so rows are neither lost nor doubled.
    """
    listed = binding_map(bindings, complexes)
    strict = listed.groupBy(*KEY).agg(F.min("complex_id").alias("complex_id"))  # the guard reports keys of several complexes
    known = listed.select("complex_id", "parcel")
    if mode == "sale":
        own = complexes.select("complex_id", clean("metadata_jibun").alias("parcel")).filter("parcel <> ''")
        known = known.unionByName(own)
    known = known.distinct().withColumn("_known", F.lit(True)).withColumnRenamed("complex_id", "_named")
    by_name = name_index(complexes, aliases=mode == "sale").withColumnRenamed("complex_id", "_named")
    found = (
        rows.join(strict.withColumnRenamed("complex_id", "_bound"), KEY, "left")
        .join(by_name, ["region", "legal_dong", "build_year", "trade_name"], "left")
        .join(known, ["_named", "parcel"], "left")
    )
    chosen = F.coalesce("_bound", F.when(F.col("_known"), F.col("_named")))
    method = F.when(F.col("_bound").isNotNull(), "binding").when(F.col("_known"), "exact_name")
    return found.select(*rows.columns, chosen.alias("complex_id"), method.alias("method"))


def link(rows: DataFrame, bindings: DataFrame, complexes: DataFrame, mode: str = "sale") -> DataFrame:
    """Add ``complex_id`` and ``method`` to rows that carry the key columns.

    The distinct keys are matched and joined back once, whatever the sizes: the number of buildings decides the cost of the
    lookups, and adaptive execution broadcasts the matched keys where they are small and splits hot keys where not.
    """
    keys = rows.select(*KEY).distinct()
    return rows.join(resolve(keys, bindings, complexes, mode), KEY, "left")


def linked_sales(rows: DataFrame, bindings: DataFrame, complexes: DataFrame, start: str, end: str) -> DataFrame:
    """Counted sale rows of the period with their complex and ``outcome``: unmatched, cancelled or saved."""
    counted = rows.filter(F.col("excluded").isNull() & let(F.col("ym"), lambda m: m.between(start, end)))
    outcome = F.when(F.col("complex_id").isNull(), "unmatched").when(F.col("cancelled"), "cancelled").otherwise("saved")
    return link(counted, bindings, complexes).withColumn("outcome", outcome)


def sale_guards(rows: DataFrame, linked: DataFrame, complexes: DataFrame, districts: DataFrame) -> DataFrame:
    """Scope, unreadable dates and keys of counted rows, and the numbers of linked active trades."""
    counted = rows.filter("excluded is null")
    no_key = F.col("parcel").isNull() | F.col("build_year").isNull()
    saved = linked.filter("outcome = 'saved'")
    return guards.all_of(
        guards.minimum_rows(rows, 100),
        guards.outside_scope(rows, "cgg_cd", districts.select("cgg_cd"), "outside_district"),
        guards.violations(counted, "bad_sale_date", F.col("date").isNull(), "building"),
        guards.violations(linked, "bad_sale_key", no_key, "building"),
        guards.violations(saved, "invalid_sale", guards.number_out_of_range(), "complex_id", F.concat_ws("/", "date", "area", "floor", "price")),
        guards.region_mismatch(linked.filter("complex_id is not null"), complexes),
    )


def reason_counts(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows per reason: what was left out before linking, and what happened to the rest."""
    before = rows.filter(F.col("excluded").isNotNull()).groupBy(F.col("excluded").alias("reason")).agg(F.count("*").alias("rows"))
    # the linked rows are counted in one pass; of no rows at all, none is linked by name
    counts = linked.groupBy("outcome", "method").agg(F.count("*").alias("n"))
    named = F.struct(F.lit("linked_by_exact_name").alias("reason"), F.when(F.col("method") == "exact_name", F.col("n")).alias("rows"))
    none = linked.sparkSession.range(1).select(F.lit("linked_by_exact_name").alias("reason"), F.lit(0).cast("bigint").alias("rows"))
    each = counts.select(F.inline(F.array(F.struct(F.col("outcome").alias("reason"), F.col("n").alias("rows")), named))).filter("rows is not null")
    after = each.unionByName(none).groupBy("reason").agg(F.sum("rows").alias("rows"))
    return before.unionByName(after)


def unmatched_buildings(linked: DataFrame) -> DataFrame:
    return linked.filter("complex_id is null").groupBy("region", "legal_dong", "parcel", "building", "build_year").agg(F.count("*").alias("rows"))


def lease_rows(raw: DataFrame, districts: DataFrame) -> DataFrame:
    """Typed lease rows with ``excluded``; only deposit leases without monthly rent count."""
    df = key_columns(raw.withColumn("cgg_cd", clean("cgg_cd"))).join(districts, "cgg_cd", "left")
    rent = number("rtfe")
    excluded = F.when(clean("bldg_usg") != fv.APARTMENT, "non_apartment").when(
        (clean("rent_se") != fv.LEASE_PURE) | (rent != 0), "monthly_rent_excluded"
    )
    unreadable = excluded.isNull() & rent.isNull()
    date = compact_date("ctrt_day")
    return df.select(
        *KEY, "cgg_cd", date.alias("date"), ym_of_date(date).alias("ym"), number("rent_area").alias("area"),
        number("flr").alias("floor"), number("grfe").alias("deposit"),
        F.coalesce(F.nullif(clean("new_updt_yn"), F.lit("")), F.lit(fv.KIND_UNKNOWN)).alias("kind"),
        clean("ctrt_updt_use_yn").alias("right_used"), clean("ctrt_prd").alias("period"),
        clean("bfr_grfe").alias("prior_deposit"), clean("bfr_rtfe").alias("prior_rent"),
        excluded.alias("excluded"), F.coalesce(unreadable, F.lit(False)).alias("rent_unreadable"),
    )


# A disclosed lease has no contract id: rows that agree in all of these are one contract.
LEASE_FINGERPRINT = ["complex_id", "date", "area", "floor", "deposit", "parcel", "kind", "right_used", "period", "prior_deposit", "prior_rent"]


def linked_leases(rows: DataFrame, bindings: DataFrame, complexes: DataFrame, start: str, end: str) -> DataFrame:
    counted = rows.filter(F.col("excluded").isNull() & let(F.col("ym"), lambda m: m.between(start, end)))
    outcome = F.when(F.col("parcel").isNull() | F.col("build_year").isNull(), "unidentified_address").when(
        F.col("complex_id").isNull(), "unmatched"
    ).otherwise("linked")
    return link(counted, bindings, complexes, "lease").withColumn("outcome", outcome)


def distinct_leases(linked: DataFrame) -> DataFrame:
    """One row per disclosed fingerprint of a linked lease; an unknown floor stays unknown."""
    whole = F.col("floor").cast("int").alias("floor")
    kept = linked.filter("outcome = 'linked'").dropDuplicates(LEASE_FINGERPRINT)
    return kept.select("complex_id", "date", "ym", "area", whole, F.col("deposit").cast("bigint").alias("deposit"), "kind", "right_used", "period")


def lease_guards(linked: DataFrame, rows: DataFrame) -> DataFrame:
    whole = F.col("floor").isNull() | (F.col("floor") == F.floor("floor"))
    bad = guards.number_out_of_range("deposit", floor_required=False) | ~whole
    return guards.all_of(
        guards.violations(rows, "rent_unreadable", F.col("rent_unreadable"), "building" if "building" in rows.columns else "trade_name"),
        guards.violations(rows.filter("excluded is null"), "bad_lease_date", F.col("date").isNull(), "trade_name"),
        guards.violations(linked.filter("outcome = 'linked'"), "invalid_lease", bad, "complex_id", F.concat_ws("/", "date", "area", "floor", "deposit")),
    )


def data_status(complexes: DataFrame, linked: DataFrame) -> DataFrame:
    """Collected, linked but nothing active (all cancelled), or not linked at all.

    A complex counts as linked before cancelled trades are left out.
    """
    seen = linked.filter("complex_id is not null").groupBy("complex_id").agg(F.count_if(F.col("outcome") == "saved").alias("_saved"))
    status = F.when(F.col("_saved") > 0, "collected").when(F.col("_saved") == 0, "no_active_trades").otherwise("matching_unconfirmed")
    return complexes.join(seen, "complex_id", "left").withColumn("data_status", status).drop("_saved")


def lease_status(complexes: DataFrame, leases: DataFrame) -> DataFrame:
    have = leases.select("complex_id").distinct().withColumn("_has", F.lit(True))
    status = F.when(F.col("_has"), "collected").otherwise("no_matched_records")
    return complexes.join(have, "complex_id", "left").withColumn("jeonse_status", status).drop("_has")


def effective_start(rows: DataFrame, configured: str) -> DataFrame:
    """One row with ``effective_start``: the configured month, or January of the first receipt year if that is later."""
    year = F.min(F.when(F.col("receipt_year").rlike("^[0-9]+$"), F.col("receipt_year").cast("int")))
    return rows.agg(year.alias("first_year")).select(
        "first_year", F.greatest(F.lit(configured), F.format_string("%04d-01", "first_year")).alias("effective_start")
    )



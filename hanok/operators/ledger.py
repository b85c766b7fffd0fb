"""Floor-area ratio from the building ledger: exactly one matching ledger, and its own areas have to agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanok.functions import fixed_values as fv
from hanok.functions.parcels import parcel, road_key
from hanok.functions.text import clean
from hanok.functions.values import integer, number


def ledger_rows(raw: DataFrame) -> DataFrame:
    """Typed ledger rows; rows whose lot or road numbers cannot be read are left out, as they can match nothing."""

    def zero(c):
        return integer(F.coalesce(F.nullif(clean(c), F.lit("")), F.lit("0"))).cast("int")

    year = F.substring(clean("use_aprv_ymd"), 1, 4)
    df = raw.select(
        clean("sgg_cd_nm").alias("district"), F.col("stdg_cd_nm").alias("legal_dong"),
        parcel("mn_lotno", "sub_lotno").alias("parcel"),
        F.struct(F.col("na_road_cd_nm").alias("road"), zero("na_mn_lotno").alias("main"), zero("na_sub_lotno").alias("sub")).alias("road"),
        number("hh_cnt").alias("ledger_households"), F.when(year.rlike("^[0-9]{4}$"), year.cast("int")).alias("ledger_year"),
        number("fart").alias("ratio"), number("siar").alias("site_area"), number("fart_cmpttn_gfa").alias("floor_area"),
        (F.contains(clean("mn_usg_cd_nm"), F.lit(fv.LEDGER_USE)) | F.contains(clean("etc_usg_cn"), F.lit(fv.LEDGER_DETAIL))).alias("residential"),
        F.col("bdrg_sn").cast("string").alias("ledger_id"), F.col("plat_plc").alias("ledger_address"),
    )
    return df.filter(F.col("parcel").isNotNull() & F.col("road.main").isNotNull() & F.col("road.sub").isNotNull())


def ledger_matches(complexes: DataFrame, bindings: DataFrame, ledger: DataFrame) -> DataFrame:
    """(complex, ledger) pairs by known parcel or by road address within the dong, each pair once, with ``copies``.

    The alternative is two equi-joins. Equal ledger rows are counted first: they stay different ledgers to the
    uniqueness rule, but travel as one record.
    """
    rows = ledger.groupBy(*ledger.columns).agg(F.count("*").alias("copies"))
    lots = bindings.select("complex_id", "legal_dong", F.col("jibun").alias("parcel")).distinct()
    own = complexes.select("complex_id", "region_name")
    c = complexes.select("complex_id", "region_name", "legal_dong", road_key("address").alias("road")).filter("road is not null")
    columns = ["complex_id", "region_name", *rows.columns]
    by_lot = rows.join(lots.join(own, "complex_id"), ["legal_dong", "parcel"]).select(*columns)
    by_road = rows.join(c, ["legal_dong", "road"]).select(*columns)
    return by_lot.unionByName(by_road).filter(F.col("district") == F.col("region_name")).distinct()


def assign_ratio(complexes: DataFrame, bindings: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every complex with its ratio, status and reason.

    ``complexes`` has ``region_name`` (as the ledger spells the district); ``ledger`` comes from :func:`ledger_rows`.
    """
    facts = complexes.select("complex_id", "households", F.coalesce("build_year", F.lit(0)).alias("build_year"))
    matches = ledger_matches(complexes, bindings, ledger).join(facts, "complex_id")
    near_households = F.abs(F.col("ledger_households") - F.col("households")) <= F.greatest(F.lit(5.0), F.col("households") * 0.01)
    near_year = F.col("ledger_year").isNull() | (F.abs(F.col("ledger_year") - F.col("build_year")) <= 2)
    good = F.coalesce(near_households & near_year & F.col("residential"), F.lit(False))
    found = F.struct("ledger_id", "ledger_address", "ledger_households", "ratio", "site_area", "floor_area")
    per = matches.groupBy("complex_id").agg(F.sum(F.when(good, F.col("copies")).otherwise(0)).alias("candidates"), F.max(F.when(good, found)).alias("l"))
    joined = complexes.join(per, "complex_id", "left")
    one = F.col("candidates") == 1
    ratio, site, floor = F.col("l.ratio"), F.col("l.site_area"), F.col("l.floor_area")
    in_domain = (ratio > 0) & (ratio <= 2000)
    differs = (F.coalesce(site, F.lit(0.0)) != 0) & (F.coalesce(floor, F.lit(0.0)) != 0) & (
        F.abs(floor / F.nullif(site, F.lit(0.0)) * 100 - ratio) > F.greatest(F.lit(0.1), ratio * 0.01)
    )
    reason = (
        F.when(F.col("candidates").isNull(), fv.FAR_NO_LEDGER)
        .when(F.col("candidates") == 0, fv.FAR_NO_CANDIDATE)
        .when(F.col("candidates") > 1, fv.FAR_MANY)
        .when(~F.coalesce(in_domain, F.lit(False)), fv.FAR_NO_VALUE)
        .when(F.coalesce(differs, F.lit(False)), fv.FAR_RATIO)
        .otherwise(fv.FAR_OK)
    )
    verified = reason == fv.FAR_OK
    kept = [c for c in complexes.columns if c not in ("far", "far_status", "far_reason", "ledger_id")]
    return joined.select(
        *kept, F.when(verified, ratio).alias("far"), F.when(verified, "verified").otherwise("unconfirmed").alias("far_status"),
        reason.alias("far_reason"), F.when(one, F.col("l.ledger_id")).alias("ledger_id"),
    )

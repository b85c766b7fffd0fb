"""Joins that complete the catalogue: seeds, exclusions, supplements, earlier attributes, regions, transport."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hanok.functions import fixed_values as fv
from hanok.functions.months import col
from hanok.functions.parcels import legal_parcels, parcel_evidence
from hanok.functions.places import region_tags
from hanok.functions.text import clean, first_nonblank, norm_name
from hanok.functions.values import completed, integer, number


def seed_attributes(complexes: DataFrame, seed: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Non-blank seed values of the same region and normalised name replace the catalogue's."""
    s = seed.select("region", norm_name("name").alias("_n"), *[F.col(f).alias(f"_s_{f}") for f in fields])
    joined = complexes.withColumn("_n", norm_name("name")).join(s, ["region", "_n"], "left")
    types = dict(complexes.dtypes)
    for f in fields:
        value = F.col(f"_s_{f}")
        if types[f] == "string":
            value = F.nullif(value, F.lit(""))
        joined = joined.withColumn(f, F.coalesce(value, F.col(f)))
    return joined.select(*complexes.columns)


def exclude(complexes: DataFrame, excluded: DataFrame, key: str = "complex_id") -> DataFrame:
    return complexes.join(excluded.select(key), key, "left_anti")


def supplement_parcels(complexes: DataFrame, national: DataFrame) -> DataFrame:
    """Fill a blank parcel from the national list: same id, district, dong, households and year, one plain parcel."""
    n = national.select(
        clean("단지코드").alias("complex_id"), clean("시군구").alias("_region"), F.col("동리").alias("_dong"),
        F.floor(number("세대수")).cast("int").alias("_hh"), integer(F.substring(clean("사용승인일"), 1, 4)).cast("int").alias("_year"),
        legal_parcels("법정동주소", "읍면", "동리").alias("_p"),
    )
    joined = complexes.join(n, "complex_id", "left")
    same = (
        (F.col("_region") == F.col("region")) & (F.col("_dong") == F.col("legal_dong"))
        & (F.col("_hh") == F.col("households")) & (F.col("_year") == F.col("build_year"))
    )
    plain = (F.size("_p") == 1) & (F.get("_p", 0)["kind"] == "1")
    take = (clean("metadata_jibun") == "") & F.coalesce(same & plain, F.lit(False))
    return joined.select(
        *[c for c in complexes.columns if c != "metadata_jibun"],
        F.when(take, F.get("_p", 0)["parcel"]).otherwise(F.col("metadata_jibun")).alias("metadata_jibun"),
        take.alias("supplemented"),
    )


def carry_forward(complexes: DataFrame, prior: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Fields of the earlier catalogue for known ids, where the new one has none."""
    p = prior.select("complex_id", *[F.col(f).alias(f"_p_{f}") for f in fields])
    joined = complexes.join(p, "complex_id", "left")
    have = set(complexes.columns)
    taken = [F.coalesce(*([F.col(f)] if f in have else []), F.col(f"_p_{f}")).alias(f) for f in fields]
    return joined.select(*[c for c in complexes.columns if c not in fields], *taken)


def fallback_features(complexes: DataFrame, prior: DataFrame, fields: Sequence[str], prior_enabled: bool) -> tuple[DataFrame, DataFrame]:
    """When enrichment failed: take the features of the prior snapshot for all ids, or nothing at all.

    Returns the completed catalogue and a violation per id that the prior snapshot does not know (or one for all of
    them when it never had features).
    """
    from hanok.operators import guards

    p = prior.select("complex_id", *fields, F.lit(True).alias("_had"))
    joined = complexes.drop(*[f for f in fields if f in complexes.columns]).join(p, "complex_id", "left")
    broken = guards.violations(joined, "no_earlier_features", F.col("_had").isNull() | F.lit(not prior_enabled), "complex_id")
    return joined.drop("_had"), broken


def resolve_region(df: DataFrame, names: Sequence[str], district="district", address="address") -> Column:
    """Configured region of a row: its district if that is one, else the first name found in the address."""
    d, a = col(district), F.coalesce(col(address), F.lit(""))
    inside = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(a, n))
    return F.when(d.isin(*names), d).otherwise(F.get(inside, 0))


def aliases_union(earlier, *names) -> Column:
    given = F.array_compact(F.array(*[col(n) for n in names]))
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(col(earlier), F.array().cast("array<string>")), given)))


def eligible_type(kind, tenure) -> Column:
    """Flats or mixed-use blocks, and not for rent only; unknown kind or tenure passes."""
    k, t = clean(kind), clean(tenure)
    flat = (k == "") | F.contains(k, F.lit(fv.APARTMENT)) | F.contains(k, F.lit(fv.MIXED_USE))
    rental_only = F.contains(t, F.lit(fv.RENTAL)) & ~F.contains(t, F.lit(fv.FOR_SALE)) & ~F.contains(t, F.lit(fv.MIXED_TENURE))
    return flat & ~rental_only


def _master_rows(rows: DataFrame, regions: Sequence[str]) -> DataFrame:
    """Rows of the official list that lie in one of the regions, by whichever names the export gives its columns."""
    def field(*names):
        present = [n for n in names if n in rows.columns]
        return first_nonblank(*present) if present else F.lit("")

    address = field("apt_rdn_addr", "kapt_newadrs", "rdn_addr")
    base = rows.select(
        field("apt_cd", "kapt_code").alias("complex_id"), field("apt_nm", "kapt_name").alias("official_name"),
        field("sgg_addr", "sigungu").alias("district"), address.alias("address"),
        number(field("tnohsh", "kaptd_pcnt")).alias("_hh"), field("cmpx_clsf", "code_apt_nm").alias("metadata_type"),
        field("hh_type", "code_sale_nm").alias("tenure"), field("emd_addr", "dong").alias("legal_dong"),
        completed(field("use_aprv_ymd", "kapt_usedate")).alias("completed"), field("daddr").alias("_detail"),
        field("apt_stdg_addr", "kapt_addr").alias("_standard"),
    )
    return base.withColumn("region", resolve_region(base, regions)).filter("region is not null")


def master_violations(rows: DataFrame, regions: Sequence[str]) -> DataFrame:
    """What must stop a run over the official list: complexes without a code or a name, codes given twice, and household
    counts that are no finite numbers (``nan`` and ``inf`` included)."""
    from hanok.operators import guards

    base = _master_rows(rows, regions)
    blank = (F.col("complex_id") == "") | (F.col("official_name") == "")
    return guards.all_of(
        guards.violations(base, "blank_complex_code_or_name", blank, "region", F.concat_ws("/", "complex_id", "official_name")),
        guards.duplicated(base.filter("complex_id <> ''"), ["complex_id"], "duplicate_complex_code"),
        guards.violations(base, "unknown_households", F.col("_hh").isNull(), "complex_id", F.col("region")),
    )


def master_catalogue(rows: DataFrame, regions: Sequence[str], prior: DataFrame | None = None, least_households: int = 300) -> tuple[DataFrame, DataFrame]:
    """City catalogue from the official list: region, size, type and tenure rules; parcels with their evidence.

    Column names are the lower-case ones of the export. Returns the catalogue and the rows with unknown households,
    which must stop the run (:func:`master_violations` tells all that must).
    """
    base = _master_rows(rows, regions)
    unknown = base.filter("_hh is null").select("complex_id", "region")
    evidence = parcel_evidence("_detail", "_standard", "region", "legal_dong")
    kept = base.filter(F.floor("_hh") >= least_households).filter(eligible_type("metadata_type", "tenure"))
    out = kept.select(
        "complex_id", "region", "official_name", "address", F.floor("_hh").cast("int").alias("households"), "legal_dong",
        F.when(F.col("completed").rlike(r"^[0-9]{4}\."), F.col("completed")).alias("completed"),
        F.when(F.col("completed").rlike(r"^[0-9]{4}\."), F.substring("completed", 1, 4).cast("int")).alias("build_year"),
        "metadata_type", "tenure", evidence.alias("_e"),
    ).select("*", F.col("_e.parcel").alias("metadata_jibun"), F.col("_e.evidence").alias("metadata_jibun_evidence")).drop("_e")
    if prior is None:
        out = out.withColumn("name", F.col("official_name")).withColumn("_aliases", F.lit(None).cast("array<string>"))
    else:
        known = prior.select("complex_id", F.nullif(clean("name"), F.lit("")).alias("_name"), F.col("aliases").alias("_aliases"))
        out = out.join(known, "complex_id", "left").withColumn("name", F.coalesce("_name", "official_name")).drop("_name")
    return out.withColumn("aliases", aliases_union("_aliases", "official_name", "name")).drop("_aliases"), unknown


NATIONAL_FACTS = ("단지명", "세대수", "사용승인일", "분양형태", "시도", "시군구")


def _of_cities(rows: DataFrame, cities: Sequence[str], province: str) -> DataFrame:
    """Rows of the national list that lie in one of the cities, with its name as ``region``."""
    short = [(c, c.removesuffix("시")) for c in cities]
    region = F.coalesce(*[F.when(F.startswith(clean("시군구"), F.lit(s)), F.lit(c)) for c, s in short])
    return rows.filter(F.col("시도") == province).withColumn("region", region).filter("region is not null")


def national_violations(rows: DataFrame, cities: Sequence[str], province: str = "경기도") -> DataFrame:
    """What must stop a run over the national list: household counts that are no numbers, and complexes without a code."""
    from hanok.operators import guards

    scoped, households, code = _of_cities(rows, cities, province), clean("세대수"), clean("단지코드")
    value = households.try_cast("double")
    unreadable = (households != "") & F.coalesce(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(True))
    return guards.all_of(
        guards.violations(scoped, "unreadable_households", unreadable, code, households),
        guards.violations(scoped, "blank_complex_code", code == "", clean("단지명")),
    )


def national_catalogue(rows: DataFrame, cities: Sequence[str], province: str = "경기도", least_households: int = 300) -> tuple[DataFrame, DataFrame]:
    """Catalogue of the given cities from the national list, and the complexes held back with a reason.

    A repeated id keeps its first row (``ord``); ids whose rows disagree on a basic fact, have an unreadable approval
    date, or join several parcels under one household count are held. See :func:`national_violations` for what must stop
    the run beforehand.
    """
    cid = clean("단지코드")
    facts = F.concat_ws("\u0001", *[clean(c) for c in NATIONAL_FACTS])
    conflict = rows.groupBy(cid.alias("complex_id")).agg((F.min(facts) != F.max(facts)).alias("_conflict"))
    scoped = _of_cities(rows, cities, province)
    scoped = scoped.withColumn("_hh", F.floor(F.coalesce(number("세대수"), F.lit(0.0))).cast("int"))
    scoped = scoped.filter((F.col("_hh") >= least_households) & F.col("단지분류").isin(fv.APARTMENT, fv.MIXED_USE) & F.col("분양형태").isin(fv.FOR_SALE, fv.MIXED_TENURE))
    approval = F.substring(clean("사용승인일"), 1, 8)
    tops = [c for c in ("최고층수(건축물대장상)", "최고층수") if c in rows.columns]
    picked = scoped.select(
        cid.alias("complex_id"), "ord", "region", clean("단지명").alias("name"), F.col("_hh").alias("households"),
        clean("도로명주소").alias("address"), clean("시군구").alias("district"),
        F.concat_ws(" ", F.nullif(clean("읍면"), F.lit("")), F.nullif(clean("동리"), F.lit(""))).alias("legal_dong"),
        F.when(approval.rlike("^[0-9]{8}$"), F.try_to_date(approval, "yyyyMMdd")).alias("_approved"),
        legal_parcels("법정동주소", "읍면", "동리").alias("metadata_parcels"),
        F.nullif(F.coalesce(number(first_nonblank(*tops)), F.lit(0.0)).cast("int"), F.lit(0)).alias("top_floor"),
    )
    fields = [c for c in picked.columns if c != "complex_id"]
    first = picked.groupBy("complex_id").agg(F.min_by(F.struct(*fields), "ord").alias("f")).select("complex_id", "f.*")
    joined = first.join(conflict, "complex_id")
    reason = (
        F.when(F.col("_conflict"), fv.HELD_CONFLICT).when(F.col("_approved").isNull(), fv.HELD_APPROVAL)
        .when(F.size("metadata_parcels") > 1, fv.HELD_PARCELS)
    )
    judged = joined.withColumn("reason", reason)
    held = judged.filter("reason is not null").select("complex_id", "name", "region", "reason")
    good = judged.filter("reason is null").select(
        "complex_id", "region", "name", F.col("name").alias("official_name"), "households", "address", "district", "legal_dong",
        F.year("_approved").alias("build_year"), F.date_format("_approved", "yyyy.MM").alias("completed"), "metadata_parcels",
        F.coalesce(F.get("metadata_parcels", 0)["parcel"], F.lit("")).alias("metadata_jibun"), "top_floor",
        F.array("name").alias("aliases"), region_tags("region", "district", "legal_dong").alias("region_tags"),
    )
    return good, held


def apply_transport(complexes: DataFrame, links: DataFrame, walks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Put the nearest walk on each complex, in place of an earlier one. Returns the catalogue and the violations that
    forbid publishing it."""
    from hanok.operators import guards

    complexes = complexes.drop("station_status", "station", "station_display", "station_walk_minutes", "station_distance_km", "station_count")

    head = walks.groupBy("complex_id").agg(
        F.min_by(F.struct("station", "lines", "minutes", "distance_m"), F.struct("distance_m", "station")).alias("w"),
        F.count("*").alias("station_count"),
    )
    out = complexes.join(links.select("complex_id", F.col("status").alias("station_status")), "complex_id", "left").join(head, "complex_id", "left")
    bare = F.regexp_replace("w.station", "역$", "")
    out = out.select(
        *[c for c in out.columns if c not in ("w", "station_count")],
        F.coalesce(bare, F.lit("")).alias("station"),
        F.coalesce(F.concat(F.concat_ws(",", "w.lines"), bare), F.lit("")).alias("station_display"),
        F.col("w.minutes").alias("station_walk_minutes"), (F.col("w.distance_m") / 1000).alias("station_distance_km"),
        F.coalesce("station_count", F.lit(0)).alias("station_count"),
    )
    broken = guards.all_of(guards.absent(complexes, links, "complex_id", "link_row_absent"), guards.walk_out_of_range(walks))
    return out, broken

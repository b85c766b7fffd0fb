"""Which (district, dong, year) the collection has to cover, from the catalogue and the official dong list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanok.functions.text import clean, norm
from hanok.operators import guards

EUP = r"^([가-힣0-9]+(?:읍|면))\s+"


def _district(c):
    return F.replace(norm(c), F.lit("시"), F.lit(""))


def coverage_plan(catalogue: DataFrame, dongs: DataFrame) -> DataFrame:
    """Entries to collect: catalogue dongs found in the official list; the dongs of one eup or myeon form one entry.

    ``dongs(code, district_name, dong_code, dong_name)``; ``catalogue(complex_id, region, district, legal_dong)``. The
    complexes of an entry stay rows (``plan_complexes``); an entry itself carries their number.
    """
    hit = plan_complexes(catalogue, dongs)
    first = F.struct("dong_code", "dong", "district", "region")
    return (
        hit.groupBy("code", "entry").agg(F.min(first).alias("f"), F.count_distinct("complex_id").alias("complexes"), F.max("eup_name").alias("eup_name"))
        .select("code", "f.dong_code", "f.dong", "f.district", "f.region", "eup_name", F.col("eup_name").isNotNull().alias("eup_scope"), "complexes")
    )


def plan_complexes(catalogue: DataFrame, dongs: DataFrame) -> DataFrame:
    """One row per (entry, complex)."""
    d = dongs.select(
        clean("code").alias("code"), _district("district_name").alias("_d"), clean("district_name").alias("district"),
        clean("dong_code").alias("dong_code"), clean("dong_name").alias("dong"), norm(clean("dong_name")).alias("_n"),
    )
    eup = F.nullif(F.regexp_extract("dong", EUP, 1), F.lit(""))
    d = d.withColumn("eup_name", eup).withColumn("entry", F.coalesce("eup_name", "dong_code"))
    c = catalogue.select("complex_id", "region", _district("district").alias("_d"), norm("legal_dong").alias("_n"))
    return d.join(c, ["_d", "_n"]).select("code", "entry", "dong_code", "dong", "district", "region", "eup_name", "complex_id")


def plan_requests(catalogue: DataFrame, dongs: DataFrame) -> DataFrame:
    """(code, dong_code, complex_id): what each request of :func:`coverage_plan` was made for."""
    hit = plan_complexes(catalogue, dongs)
    asked = hit.groupBy("code", "entry").agg(F.min("dong_code").alias("dong_code"))
    return hit.drop("dong_code").join(asked, ["code", "entry"]).select("code", "dong_code", "complex_id").distinct()


def former_district_plan(catalogue: DataFrame, dongs: DataFrame, renamed: DataFrame) -> DataFrame:
    """Entries under a former district code: same dong, its later name, or all dongs of an eup or myeon.

    ``renamed(old_dong, canonical)``; ``dongs`` as above with the former code; the catalogue is that of the city.
    """
    d = dongs.select(clean("code").alias("code"), clean("dong_code").alias("dong_code"), clean("dong_name").alias("dong"))
    d = d.join(renamed, F.col("dong") == F.col("old_dong"), "left").withColumn("canonical_dong", F.coalesce("canonical", "dong"))
    c = catalogue.select("complex_id", "region", "legal_dong", norm("legal_dong").alias("_n"), F.regexp_extract("legal_dong", r"^(\S+) ", 1).alias("_eup"))
    same = d.withColumn("_n", norm("canonical_dong")).join(c.drop("_eup"), "_n")
    is_eup = d.filter(F.col("dong").endswith("읍") | F.col("dong").endswith("면"))
    inside = is_eup.join(c, F.col("dong") == F.col("_eup"))
    columns = ["code", "dong_code", "dong", "canonical_dong", "region", "complex_id"]
    return same.select(*columns).unionByName(inside.select(*columns)).distinct()


def jobs(plan: DataFrame, start: str, end: str) -> DataFrame:
    """One job per entry and year, with the months of that year that are asked for."""
    first, last = int(start[:4]), int(end[:4])
    year = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year")
    return plan.select("*", year).select(
        "*", F.greatest(F.lit(start), F.concat(F.col("year").cast("string"), F.lit("-01"))).alias("from_month"),
        F.least(F.lit(end), F.concat(F.col("year").cast("string"), F.lit("-12"))).alias("to_month"),
    )


def uncovered(catalogue: DataFrame, covered: DataFrame) -> DataFrame:
    """Complexes without an entry: reported, not dropped."""
    return catalogue.join(covered.select("complex_id").distinct(), "complex_id", "left_anti")


def cities_without_plan(catalogue: DataFrame, covered: DataFrame) -> DataFrame:
    return guards.nothing_linked(covered, "region", catalogue.select("region").distinct(), "city_without_plan")

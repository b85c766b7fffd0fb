"""Small lookup tables from configuration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from hanok.functions import fixed_values as fv


def region_codes(spark: SparkSession, regions: Sequence[Mapping]) -> DataFrame:
    """``(cgg_cd, region, least)``; a code or name given twice is a configuration error."""
    if not regions:
        raise ValueError("no regions configured")
    codes, names = {str(r["code"]) for r in regions}, {r["name"] for r in regions}
    if len(codes) != len(regions) or len(names) != len(regions):
        raise ValueError("region configured twice")
    rows = [(str(r["code"]), r["name"], int(r.get("minimum_expected_complexes", 1))) for r in regions]
    return spark.createDataFrame(rows, "cgg_cd string, region string, least int")


def station_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fv.STATION_LINES.items()), "station string, lines string")


def region_tiers(spark: SparkSession, tiers: Mapping[str, int] = fv.REGION_TIERS) -> DataFrame:
    return spark.createDataFrame(list(tiers.items()), "region string, tier int")


def exclusions(spark: SparkSession, ids: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "complex_id string")

"""Removing copies: rows, complexes, and complexes made of unmatched trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hanok.functions.text import clean, norm_name


def distinct_rows(trades: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key; copies are removed on the map side before the shuffle."""
    return trades.dropDuplicates(list(key))


def copies_removed(trades: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: rows before, distinct rows, copies removed."""
    per_key = trades.groupBy(*key).agg(F.count("*").alias("n"))
    return per_key.agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_rows"), F.sum(F.col("n") - 1).alias("removed"))


def _present(c: str, dtype: str) -> Column:
    if dtype == "string":
        return F.col(c).isNotNull() & (F.col(c) != "")
    if dtype.startswith("array"):
        return F.size(c) > 0
    return F.col(c).isNotNull()


def collapse_key(complexes: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(norm_name("name"), F.lit("")), clean("name"))
    return complexes.select("*", clean("region").alias("_r"), name.alias("_n"), clean("address").alias("_a"))


def collapse_complexes(complexes: DataFrame, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """Merge complexes of the same region, normalised name and address.

    The first in catalogue order is kept; its blank fields take the first value that another one has. Returns the
    merged complexes and the map ``old_id -> complex_id`` for the trades. Different addresses are never merged.
    """
    keyed = collapse_key(complexes)
    key = ["_r", "_n", "_a"]
    kept_as_is = {"name", "region", "address", order}
    fields = []
    for name, dtype in complexes.dtypes:
        when = F.col(order) if name in kept_as_is else F.when(_present(name, dtype), F.col(order))
        fields.append(F.min_by(F.col(name), when).alias(name))
    merged = keyed.groupBy(*key).agg(*fields)
    ids = keyed.select(*key, F.col("complex_id").alias("old_id"))
    renamed = ids.join(merged.select(*key, "complex_id"), key).select("old_id", "complex_id")
    return merged.drop(*key), renamed


def rekey_trades(trades: DataFrame, renamed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Trades under the id of the merged complex, equal ones once."""
    moved = trades.withColumnRenamed("complex_id", "old_id").join(renamed, "old_id").drop("old_id")
    return moved.select("complex_id", *columns).distinct()


def trade_only_complexes(unmatched: DataFrame) -> DataFrame:
    """One complex per (region, normalised name) of unmatched trades; the id is the smallest trade sequence, or made of
    region and name where no trade has one.

    The first trade by (date, sequence) gives the descriptive fields. Trades are matched against the input catalogue
    only, so the outcome does not depend on the order in which trades arrive.
    """
    first = F.struct("date", "apt_seq")
    return (
        unmatched.withColumn("_n", norm_name("name"))
        .groupBy("region", F.col("_n").alias("match_name"))
        .agg(
            F.min(F.nullif("apt_seq", F.lit(""))).alias("complex_id"),
            F.min_by(F.struct("name", "build_year", "legal_dong", "jibun"), first).alias("f"),
            F.count("*").alias("trades"),
        )
        .select(
            F.coalesce("complex_id", F.concat_ws("-", "region", F.lit("trade"), "match_name")).alias("complex_id"), "region", "match_name", "f.name", "f.build_year", "f.legal_dong",
            F.concat_ws(" ", "region", F.nullif(F.col("f.legal_dong"), F.lit("")), F.nullif(F.col("f.jibun"), F.lit(""))).alias("address"),
            F.concat(F.col("f.build_year").cast("string"), F.lit(".01")).alias("completed"), "trades",
        )
    )

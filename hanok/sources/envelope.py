"""Envelope JSON ``{"DATA": [ {..}, .. ]}``: one response per file, or one per line."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hanok.operators.guards import violations

ROWS = "DATA array<map<string,string>>"


def read_envelopes(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Envelopes with their file and parsed rows; keys in lower case, numbers as written (long ids keep all digits).

    ``lines=True`` reads many envelopes per file, one per line, which Spark can split.
    """
    text = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_name").alias("file"), "value")
    parsed = text.withColumn("rows", F.from_json("value", ROWS)["DATA"])
    low = F.transform("rows", lambda m: F.transform_keys(m, lambda k, v: F.lower(k)))
    return parsed.select("file", low.alias("rows"))


def envelope_rows(envelopes: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The rows of all envelopes with the wanted fields; a missing field is null."""
    row = envelopes.select("file", F.explode("rows").alias("r"))
    return row.select("file", *[F.element_at("r", F.lit(f)).alias(f) for f in fields])


def envelope_violations(envelopes: DataFrame, allow_empty: bool = False) -> DataFrame:
    """Responses that are no JSON, have no row list, or an empty one (unless that is allowed)."""
    broken = F.col("rows").isNull() if allow_empty else F.coalesce(F.size("rows") < 1, F.lit(True))
    return violations(envelopes, "bad_envelope", broken, "file")


def to_envelopes(rows: DataFrame, page: int = 1000, upper: bool = True) -> DataFrame:
    """Rows as envelope texts (column ``value``) of at most ``page`` rows each, as a portal pages its responses."""
    names = [c.upper() if upper else c for c in rows.columns]
    item = F.struct(*[F.col(c).alias(n) for c, n in zip(rows.columns, names)])
    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # consecutive rows of a partition share a page: nothing is shuffled and a task holds one page
        held: list[str] = []

        def text():
            return pd.DataFrame({"value": ['{"DATA":[' + ",".join(held) + "]}"]})

        for batch in batches:
            for item in batch["item"]:
                held.append(item)
                if len(held) == page:
                    yield text()
                    held.clear()
        if held:
            yield text()

    return rows.select(F.to_json(item).alias("item")).mapInPandas(pages, "value string")

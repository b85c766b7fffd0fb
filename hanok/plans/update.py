"""Monthly update of all providers: collect, backfill, merge, check, publish."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hanok.operators import guards
from hanok.operators import incremental as inc
from hanok.operators.coverage import region_coverage
from hanok.plans.official import Outcome
from hanok.plans.publish import publish_snapshot


def backfill(window: Outcome, full: Outcome, catalogue: DataFrame, prior: DataFrame) -> Outcome:
    """Complexes that the last snapshot did not know take their full history instead of the refresh window."""
    tables = dict(window.tables)
    for name in ("sales", "leases"):
        tables[name] = inc.backfill_new(window.tables[name], full.tables[name], catalogue, prior)
    return Outcome(tables, window.reports, window.problems + full.problems)


def merge(official: Outcome, portal: Outcome) -> Outcome:
    """Both providers as one snapshot."""
    tables = {
        name: inc.merge_providers(("official", official.tables[name]), ("portal", portal.tables[name]))
        for name in ("complexes", "sales", "leases")
    }
    reports = {f"official_{k}": v for k, v in official.reports.items()} | {f"portal_{k}": v for k, v in portal.reports.items()}
    reports["coverage"] = region_coverage(tables["complexes"], tables["sales"], tables["leases"])
    return Outcome(tables, reports, official.problems + portal.problems)


def checks(regions: DataFrame, least_households: int, start: str, end: str):
    """Rules on the staged tables of a merged snapshot."""

    def run(staged: dict[str, DataFrame]) -> list[DataFrame]:
        complexes, sales, leases = staged["complexes"], staged["sales"], staged["leases"]
        return [
            guards.duplicated(complexes, ["complex_id"], "complex_id_twice"),
            guards.invalid_complexes(complexes, regions, least_households),
            guards.invalid_trades(sales),
            guards.lease_shape(leases, start, end),
            guards.ratio_status(complexes),
            guards.absent(sales.select("complex_id").distinct(), complexes, "complex_id", "unknown_complex"),
        ]

    return run


def publish(spark: SparkSession, root: str, version: str, outcome: Outcome, regions: DataFrame, least_households: int, start: str, end: str) -> dict:
    """Stage, check and publish a merged snapshot; the earlier one stays in place on any failure."""
    outcome.enforce()
    return publish_snapshot(
        spark, root, version,
        {
            "complexes": (outcome.tables["complexes"], "region", ("complex_id",)),
            "sales": (outcome.tables["sales"], "ym", ("complex_id", "date")),
            "leases": (outcome.tables["leases"], "ym", ("complex_id", "date")),
        },
        checks(regions, least_households, start, end),
    )


def documents(complexes: DataFrame, sales: DataFrame, leases: DataFrame, key: str = "complex_id", order=("region", "complex_id")) -> tuple[DataFrame, DataFrame]:
    """Nested documents ``(region, ord, id, json)`` for part files, and the sizes from which oversized ones are told.

    Check the sizes first: only then is every complex known to be small enough to be built in one place.
    """
    from hanok.operators.ranking import number_rows
    from hanok.sources.parts import escape_script

    def nested(trades, name):
        item = F.struct(*[c for c in trades.columns if c not in (key, "ym")])
        return trades.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias(name))

    def size(trades):
        item = escape_script(F.to_json(F.struct(*[c for c in trades.columns if c != key])))
        return trades.groupBy(key).agg(F.sum(F.octet_length(item) + 1).alias("bytes"))

    # as they will be written: escaping lengthens a text
    heads = complexes.withColumn("_b", F.octet_length(escape_script(F.to_json(F.struct(*complexes.columns)))))
    sizes = heads.select(key, F.col("_b").cast("bigint").alias("bytes")).unionByName(size(sales)).unionByName(size(leases))
    sizes = sizes.groupBy(key).agg(F.sum("bytes").alias("bytes"))
    numbered = number_rows(complexes, *[F.col(c) for c in order], name="ord")
    full = numbered.join(nested(sales, "tx"), key, "left").join(nested(leases, "jeonse_tx"), key, "left")
    body = F.to_json(F.struct(F.col(key).alias("id"), *[c for c in full.columns if c not in (key, "ord")]))
    return full.select("region", "ord", F.col(key).cast("string").alias("id"), escape_script(body).alias("json")), sizes


def publish_parts(spark: SparkSession, root: str, version: str, tables: dict[str, DataFrame], max_bytes: int | None = None) -> None:
    """A checked snapshot's complexes with their trades as part files below ``root``, all or nothing."""
    from hanok.functions.fixed_values import PART_MAX_BYTES
    from hanok.sources import part_store, parts

    limit = max_bytes or PART_MAX_BYTES
    docs, sizes = documents(tables["complexes"], tables["sales"], tables["leases"])
    guards.enforce(parts.oversized(sizes, limit))  # before any complex is built in one place
    part_store.write_store(docs, root, version, limit)

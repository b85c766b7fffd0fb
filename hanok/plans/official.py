"""City job over official exports: catalogue, sales, leases, ratios, guards, reports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanok.operators import guards
from hanok.operators import incremental as inc
from hanok.operators import linking as ln
from hanok.operators.coverage import month_counts
from hanok.operators.ledger import assign_ratio, ledger_rows


@dataclass
class Outcome:
    """Tables of a job, its reports, and the violations that must be empty before anything is published."""

    tables: dict[str, DataFrame]
    reports: dict[str, DataFrame] = field(default_factory=dict)
    problems: list[DataFrame] = field(default_factory=list)

    def enforce(self) -> "Outcome":
        guards.enforce(*self.problems)
        return self


def collect_sales(
    catalogue: DataFrame, raw: DataFrame, bindings: DataFrame, districts: DataFrame, start: str, end: str,
    stored: DataFrame | None = None, effective: str | None = None,
) -> Outcome:
    """Link official sales of ``effective .. end`` to the catalogue. Identical rows are different trades and all stay.

    ``stored`` are the sales of the last verified snapshot: they guard against a collapse, and its months between
    ``start`` and ``effective`` are kept as they are. ``effective`` comes from :func:`linking.effective_start`.
    """
    effective = effective or start
    rows = ln.sale_rows(raw, districts)
    linked = ln.linked_sales(rows, bindings, catalogue, effective, end)
    saved = linked.filter("outcome = 'saved'").select(
        "complex_id", "date", "ym", "area", "floor", "price", "legal_dong", "parcel"
    )
    counted = rows.filter(F.col("excluded").isNull() & F.col("ym").between(effective, end))
    problems = [
        ln.sale_guards(rows, linked, catalogue, districts),
        ln.binding_conflicts(bindings, catalogue),
        guards.missing_months(counted, "region", districts.select("region"), effective, end),
        guards.minimum_rows(saved, 1, "nothing_linked"),
        guards.invalid_trades(saved),
    ]
    sales = saved
    if stored is not None:
        # complexes that left the catalogue, and those of other providers, neither collapse nor stay
        stored = stored.join(catalogue.select("complex_id"), "complex_id", "left_semi")
        problems.append(guards.collapsed(stored, saved, "complex_id", effective, end))
        sales = inc.freeze_history(stored, saved, start, effective)
    complexes = ln.data_status(catalogue, linked)
    unresolved = complexes.filter("data_status = 'matching_unconfirmed'").select("complex_id", "region", "name")
    return Outcome(
        {"complexes": complexes, "sales": sales},
        {
            "reasons": ln.reason_counts(rows, linked), "unmatched": ln.unmatched_buildings(linked),
            "unresolved": unresolved, "region_months": month_counts(counted, "region"),
        },
        problems,
    )


def enrich(
    complexes: DataFrame, leases_raw: DataFrame, ledger_raw: DataFrame, bindings: DataFrame, districts: DataFrame,
    start: str, end: str, prior: dict[str, DataFrame] | None = None, city: str = "서울특별시 ",
) -> Outcome:
    """Add ratios and deposit leases. ``prior`` holds the last snapshot's tables, if that had both features."""
    with_name = complexes.withColumn("region_name", F.concat(F.lit(city), "region"))
    rated = assign_ratio(with_name, bindings, ledger_rows(ledger_raw)).drop("region_name")
    rows = ln.lease_rows(leases_raw, districts)
    linked = ln.linked_leases(rows, bindings, complexes, start, end)
    leases = ln.distinct_leases(linked)
    problems = [
        guards.outside_scope(rows, "cgg_cd", districts.select("cgg_cd"), "outside_district"),
        ln.lease_guards(linked, rows),
        guards.missing_months(rows.filter("excluded is null"), "region", districts.select("region"), start, end, "missing_lease_month"),
        guards.minimum_rows(leases, 1, "no_lease_linked"),
        guards.lease_shape(leases, start, end),
        guards.ratio_status(rated),
    ]
    if prior is not None:
        before = prior["leases"].join(complexes.select("complex_id"), "complex_id", "left_semi")
        problems.append(guards.collapsed(before, leases, "complex_id", start, end, guard="leases_collapsed"))
    return Outcome({"complexes": ln.lease_status(rated, leases), "leases": leases}, {"lease_months": month_counts(rows.filter("excluded is null"), "region")}, problems)

"""Province job over portal responses: sales and leases of the same rows, incremental with kept history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanok.operators import cascade as cs
from hanok.operators import guards
from hanok.operators import incremental as inc
from hanok.operators.coverage import month_counts
from hanok.plans.official import Outcome


def collect(
    catalogue: DataFrame, responses: DataFrame, start: str, end: str,
    stored: dict[str, DataFrame] | None = None, preserve: bool = False, require_months: bool = True,
    plan: DataFrame | None = None,
) -> Outcome:
    """Link the contracts of portal responses (see :func:`cascade.contracts` for the row shape).

    ``stored`` has ``complexes``, ``sales`` and ``leases`` of the last snapshot; with ``preserve`` its months before
    ``start`` are kept for complexes whose identity did not change. ``plan(code, dong_code, complex_id)`` (see
    :func:`coverage_plan.plan_requests`) keeps every response to the complexes it was asked for; a response to a request
    that the plan does not hold stops the run.
    """
    rows = cs.contracts(responses, cs.bound(cs.sites_of(responses), catalogue, plan))
    linked = cs.linked_contracts(rows, catalogue, start, end, plan)
    saved = cs.distinct_contracts(linked)
    sales = saved.filter("side = 'sale'").select("complex_id", "date", "ym", "area", "floor", "price", "legal_dong", "parcel")
    leases = saved.filter("side = 'lease'").select("complex_id", "date", "ym", "area", "floor", F.col("price").alias("deposit"), "kind")
    counted = rows.filter(F.col("excluded").isNull() & F.col("ym").between(start, end))
    cities = catalogue.select("region").distinct()
    problems = [cs.contract_guards(rows, linked)]
    if plan is not None:
        problems.append(guards.outside_plan(rows, plan, cs.REQUEST))
    if require_months:
        homes = catalogue.select("complex_id", "region")
        problems += [
            guards.missing_months(counted.filter("side = 'sale'"), "region", cities, start, end),
            guards.nothing_linked(sales.join(homes, "complex_id"), "region", cities),
        ]
    out_sales, out_leases = sales, leases
    if stored is not None:
        own = catalogue.select("complex_id")  # complexes that left it, and other providers', neither collapse nor stay
        stored = stored | {name: stored[name].join(own, "complex_id", "left_semi") for name in ("sales", "leases")}
        first = start if preserve else "0000-00"
        last = end if preserve else "9999-99"
        problems += [
            guards.collapsed(stored["sales"], sales, "complex_id", first, last),
            guards.collapsed(stored["leases"], leases, "complex_id", first, last, guard="leases_collapsed"),
        ]
        if preserve:
            problems.append(inc.identity_conflicts(stored["complexes"], catalogue))
            out_sales = inc.preserve_history(stored["sales"], sales, catalogue, start)
            out_leases = inc.preserve_history(stored["leases"], leases, catalogue, start)
    seen = linked.filter("complex_id is not null").select("complex_id").distinct().withColumn("_linked", F.lit(True))
    sold = out_sales.select("complex_id").distinct().withColumn("_sold", F.lit(True))
    let = out_leases.select("complex_id").distinct().withColumn("_let", F.lit(True))
    complexes = catalogue.join(seen, "complex_id", "left").join(sold, "complex_id", "left").join(let, "complex_id", "left")
    complexes = complexes.join(cs.binding_methods(linked), "complex_id", "left").select(
        *catalogue.columns, "trade_binding_methods",
        F.when(F.col("_sold"), "collected").when(F.col("_linked"), "no_active_trades").otherwise("matching_unconfirmed").alias("data_status"),
        F.when(F.col("_let"), "collected").otherwise("no_matched_records").alias("jeonse_status"),
    )
    return Outcome(
        {"complexes": complexes, "sales": out_sales, "leases": out_leases},
        {
            "reasons": cs.reason_counts(rows, linked),
            "raw_months": month_counts(counted, "region", "side"),
            "unmatched": linked.filter("complex_id is null").groupBy("region", "building", "parcel", "build_year").agg(F.count("*").alias("rows")),
            "unresolved": complexes.filter("data_status = 'matching_unconfirmed'").select("complex_id", "region", "name"),
        },
        problems,
    )

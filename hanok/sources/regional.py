"""Union of separately collected region parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from hanok.operators import guards


def union_regions(parts: list[DataFrame], status: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All complexes of the parts, and what forbids using them: a region missing, twice or incomplete, or a complex
    with the same region, name and address as another.

    ``status(region, months_requested, months_succeeded)`` has one row per part; ``expected(region)``.
    """
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    problems = guards.all_of(
        guards.parts_incomplete(status, expected), guards.duplicated(merged, ["region", "name", "address"], "complex_twice")
    )
    return merged, problems

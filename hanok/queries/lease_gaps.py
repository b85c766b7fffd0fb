"""Deposit reference, gap, and the floor rules of the newer sale base."""

from __future__ import annotations

from pyspark.sql import functions as F

from hanok.operators import estimate as est
from hanok.operators import lease_gap as lg
from hanok.operators.coverage import top_floors
from hanok.plans.comparison import sides
from hanok.queries.comparison import ESTIMATES, FROM, TO
from hanok.registry import query
from hanok.starmap import COMPLEX, LEASE, SALE

REFERENCE = f"""tops AS (SELECT complex_id, max(floor) AS top_floor FROM sale GROUP BY 1),
pool AS (SELECT l.*, e.value, e.w FROM lease l JOIN est e USING (complex_id) LEFT JOIN tops USING (complex_id) WHERE e.side = 'start' AND e.area_type = 59 AND l.ym BETWEEN '1997-06' AND '{FROM}'
  AND l.floor >= 4 AND (top_floor IS NULL OR l.floor < top_floor) AND abs(CAST(l.area AS DECIMAL(9,3)) - e.cluster_area) <= 0.1 AND kind = '신규'),
best AS (SELECT complex_id, max(deposit) AS deposit, count(*) AS lease_rows, arg_max(strftime(date, '%Y-%m-%d'), (deposit, date, floor)) AS lease_date FROM pool GROUP BY 1)"""


def _start(star):
    targets = {"start": sides(FROM, TO)["start"]}
    bands = {59: est.fv.ANALYSIS_BANDS[59]}
    return est.estimates(star.sales, targets, bands)


@query("lease_reference", "E8 A11 A12", f"""WITH {SALE}, {LEASE}, {ESTIMATES}, {REFERENCE} SELECT complex_id, deposit, lease_rows, lease_date FROM best""")
def lease_reference(star):
    tops = top_floors(star.complexes, star.sales)
    ref = lg.lease_reference(_start(star), star.leases, tops, FROM)
    return ref.select("complex_id", "deposit", "lease_rows", F.col("lease_date").cast("string").alias("lease_date"))


@query("lease_gaps", "E8", f"""WITH {SALE}, {LEASE}, {ESTIMATES}, {REFERENCE} SELECT complex_id, value, deposit, CASE WHEN w <= 3 THEN value - deposit END AS gap
FROM est LEFT JOIN best USING (complex_id) WHERE side = 'start' AND area_type = 59""")
def lease_gaps(star):
    start = _start(star)
    ref = lg.lease_reference(start, star.leases, top_floors(star.complexes, star.sales), FROM)
    return lg.gaps(start, ref).select("complex_id", "value", "deposit", "gap")


@query("middle_floor_sales", "E9 A12", f"""WITH {SALE}, tops AS (SELECT complex_id, max(floor) AS top_floor FROM sale GROUP BY 1) SELECT complex_id, ym, count(*) AS n, CAST(sum(price) AS BIGINT) AS total FROM sale JOIN tops USING (complex_id) WHERE floor >= 4 AND floor < top_floor GROUP BY 1, 2""")
def middle_floor_sales(star):
    kept = lg.middle_floor_sales(star.sales, star.complexes)
    return kept.groupBy("complex_id", "ym").agg(F.count("*").alias("n"), F.sum("price").alias("total"))


@query("substitute_types", "E9 F8", f"""WITH {SALE}, {COMPLEX}, t AS (SELECT complex_id, CASE WHEN far > 500 AND area < 70 THEN area + 10 ELSE area END AS area FROM sale JOIN complex USING (complex_id)),
h AS (SELECT complex_id, bool_or(area BETWEEN 57 AND 61.5) AS narrow, arg_min(area, abs(area - 59) * 1000000 + area) AS nearest FROM t WHERE area >= 45 AND area < 75 GROUP BY 1)
SELECT complex_id, area, CAST(NOT narrow AS INT) AS substitute, count(*) AS n FROM t JOIN h USING (complex_id) WHERE area >= 45 AND area < 75 AND (area BETWEEN 57 AND 61.5 OR NOT narrow AND area = nearest) GROUP BY 1, 2, 3""")
def substitute_types(star):
    # complexes with a high ratio get larger flats, so that the wider band has work to do
    t = star.sales.join(star.complexes.select("complex_id", "far"), "complex_id")
    t = t.withColumn("area", F.when((F.col("far") > 500) & (F.col("area") < 70), F.col("area") + 10).otherwise(F.col("area")))
    kept = lg.widened_type(t.select("complex_id", "area"))
    return kept.groupBy("complex_id", "area", F.col("substitute").cast("int").alias("substitute")).agg(F.count("*").alias("n"))

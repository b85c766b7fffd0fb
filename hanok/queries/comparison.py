"""Price estimation, comparison and ranking over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hanok.functions.months import month_index
from hanok.operators import estimate as est
from hanok.plans import comparison as cmp
from hanok.registry import query
from hanok.starmap import COMPLEX, SALE

FROM, TO = "1998-06", "2000-06"
TARGETS = cmp.sides(FROM, TO)

CLUSTERS = f"""typed AS (
  SELECT *, CASE WHEN area BETWEEN 57 AND 61.5 THEN 59 WHEN area BETWEEN 82 AND 86.5 THEN 84 END AS area_type,
    CAST(area AS DECIMAL(9,2)) AS cluster_area
  FROM sale WHERE floor >= 10 AND (area BETWEEN 57 AND 61.5 OR area BETWEEN 82 AND 86.5)),
counted AS (SELECT complex_id, area_type, cluster_area, count(*) AS trades FROM typed GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER k AS n, first_value(cluster_area) OVER k AS primary_area FROM counted
  WINDOW k AS (PARTITION BY complex_id, area_type ORDER BY trades DESC, abs(cluster_area - area_type), cluster_area)),
clusters AS (SELECT *, row_number() OVER (PARTITION BY complex_id, area_type
  ORDER BY CASE WHEN n = 1 THEN 0 ELSE 1 END, abs(cluster_area - primary_area), trades DESC, n) AS place FROM numbered)"""

ESTIMATES = CLUSTERS + f""",
target(side, t, nf) AS (VALUES ('start', {month_index(FROM)}, false), ('end', {month_index(TO)}, true)),
cand AS (SELECT complex_id, area_type, cluster_area, side, price, abs(midx - t) AS d, date, floor, area
  FROM typed JOIN target ON abs(midx - t) <= 12 AND NOT (nf AND midx > t)),
ctx AS (SELECT complex_id, area_type, cluster_area, side, count(*) FILTER (d <= 3) AS cn,
    quantile_cont(price, 0.5) FILTER (d <= 3) AS center FROM cand GROUP BY ALL),
dev AS (SELECT complex_id, area_type, cluster_area, side, any_value(cn) AS cn, any_value(center) AS center,
    quantile_cont(abs(price - center), 0.5) FILTER (d <= 3) AS mad
  FROM cand JOIN ctx USING (complex_id, area_type, cluster_area, side) GROUP BY 1, 2, 3, 4),
flagged AS (SELECT c.*, cn, center, greatest(center * 0.2, mad * 1.4826 * 3, 10000) AS threshold,
    cn < 3 OR abs(price - center) <= greatest(center * 0.2, mad * 1.4826 * 3, 10000) AS normal
  FROM cand c JOIN dev USING (complex_id, area_type, cluster_area, side)),
windows AS (SELECT complex_id, area_type, cluster_area, side, w, count(*) FILTER (normal AND d <= w) AS kept, any_value(cn) AS cn
  FROM flagged, (VALUES (0), (1), (2), (3), (6), (12)) v(w) GROUP BY 1, 2, 3, 4, 5),
pick AS (SELECT complex_id, area_type, cluster_area, side, min(w) AS w FROM windows
  WHERE kept >= 2 OR (kept = 1 AND (w = 12 OR (w = 0 AND cn >= 3))) GROUP BY 1, 2, 3, 4),
used AS (SELECT f.*, w, CAST(CASE WHEN d = 0 THEN 1 WHEN d = 1 THEN 0.8 WHEN d = 2 THEN 0.65 WHEN d = 3 THEN 0.5
    WHEN d <= 6 THEN 0.3 ELSE 0.15 END AS DECIMAL(6,2)) AS weight
  FROM flagged f JOIN pick USING (complex_id, area_type, cluster_area, side) WHERE d <= w),
running AS (SELECT *, sum(weight) OVER (PARTITION BY complex_id, area_type, cluster_area, side ORDER BY price ROWS UNBOUNDED PRECEDING) AS cum,
    sum(weight) OVER (PARTITION BY complex_id, area_type, cluster_area, side) AS total,
    lead(price) OVER (PARTITION BY complex_id, area_type, cluster_area, side ORDER BY price) AS following
  FROM used WHERE normal),
middle AS (SELECT complex_id, area_type, cluster_area, side,
    arg_min(CASE WHEN cum * 2 = total AND following IS NOT NULL THEN (price + following) / 2 ELSE price END, cum) AS value
  FROM running WHERE cum * 2 >= total GROUP BY 1, 2, 3, 4),
series AS (SELECT complex_id, area_type, cluster_area, side, any_value(w) AS w,
    quantile_cont(price, 0.25) FILTER (normal) AS low, quantile_cont(price, 0.75) FILTER (normal) AS high,
    count(*) FILTER (normal) AS samples, count(*) FILTER (NOT normal) AS outliers,
    any_value(center) AS center, CASE WHEN any_value(cn) >= 3 THEN any_value(threshold) END AS threshold
  FROM used GROUP BY 1, 2, 3, 4),
est AS (SELECT * FROM (SELECT s.*, value, primary_area, place,
    row_number() OVER (PARTITION BY s.complex_id, s.area_type, s.side ORDER BY place) AS first_place
  FROM series s JOIN middle USING (complex_id, area_type, cluster_area, side)
  JOIN clusters USING (complex_id, area_type, cluster_area)) WHERE first_place = 1)"""


@query("area_clusters", "E1 A7 W2 F8", f"""WITH {SALE}, {CLUSTERS}
SELECT complex_id, area_type, CAST(cluster_area AS DOUBLE) AS cluster_area, trades, CAST(primary_area AS DOUBLE) AS primary_area, place FROM clusters""")
def area_clusters(star):
    return est.area_clusters(est.typed_trades(star.sales)).select(
        "complex_id", F.col("area_type").cast("int").alias("area_type"), F.col("cluster_area").cast("double").alias("cluster_area"),
        "trades", F.col("primary_area").cast("double").alias("primary_area"), F.col("place").cast("bigint").alias("place"),
    )


@query("series_estimates", "E2 E3 E4 A8 A9 A10 W3 W5 P24", f"""WITH {SALE}, {ESTIMATES}
SELECT complex_id, area_type, CAST(cluster_area AS DOUBLE) AS cluster_area, side, value, low, high, w AS window_months, samples, outliers, center, threshold
FROM series JOIN middle USING (complex_id, area_type, cluster_area, side)""")
def series_estimates(star):
    counts = est.price_counts(est.typed_trades(star.sales), TARGETS)
    return est.series_estimates(counts).select(
        "complex_id", "area_type", F.col("cluster_area").cast("double").alias("cluster_area"), "side", "value", "low", "high",
        F.col("window").alias("window_months"), "samples", "outliers", "center", "threshold",
    )


@query("price_estimates", "E5", f"""WITH {SALE}, {ESTIMATES}
SELECT complex_id, area_type, side, value, low, high, samples, w AS window_months, outliers,
  CAST(cluster_area AS DOUBLE) AS area_used, CAST(primary_area AS DOUBLE) AS primary_area, CAST(place > 1 AS INT) AS area_fallback FROM est""")
def price_estimates(star):
    return est.estimates(star.sales, TARGETS).select(
        "complex_id", "area_type", "side", "value", "low", "high", "samples", F.col("window").alias("window_months"), "outliers",
        F.col("area_used").cast("double").alias("area_used"), F.col("primary_area").cast("double").alias("primary_area"),
        F.col("area_fallback").cast("int").alias("area_fallback"),
    )


@query("evidence_samples", "O4", f"""WITH {SALE}, {ESTIMATES}
SELECT complex_id, area_type, side, strftime(date, '%Y-%m-%d') AS date, floor, area, price, d AS distance,
  row_number() OVER (PARTITION BY complex_id, area_type, side ORDER BY date DESC, price DESC, floor, area) AS place
FROM used JOIN est USING (complex_id, area_type, cluster_area, side) WHERE normal""")
def evidence_samples(star):
    found = est.evidence(star.sales, est.estimates(star.sales, TARGETS), TARGETS)
    return found.select("complex_id", "area_type", "side", F.col("date").cast("string").alias("date"), "floor", "area", "price", "distance", "place")


def _side(prefix):
    return f"""{prefix}.value AS {prefix}_value, {prefix}.low AS {prefix}_low, {prefix}.high AS {prefix}_high, {prefix}.samples AS {prefix}_samples,
  {prefix}.w AS {prefix}_window, {prefix}.outliers AS {prefix}_outliers, CAST({prefix}.cluster_area AS DOUBLE) AS {prefix}_area,
  CAST({prefix}.primary_area AS DOUBLE) AS {prefix}_primary_area"""


def _penalty(side):
    return f"""(CASE WHEN {side}_area <> {side}_primary_area THEN 1 ELSE 0 END + CASE WHEN {side}_window = 0 THEN 0 WHEN {side}_window <= 1 THEN 1
  WHEN {side}_window <= 3 THEN 2 ELSE 3 END + CASE WHEN {side}_samples <= 2 THEN 1 ELSE 0 END + CASE WHEN {side}_outliers > 0 THEN 1 ELSE 0 END)"""


def _reasons(side, label):
    return f"""CASE WHEN {side}_area <> {side}_primary_area THEN printf('{label}: 대표 전용 %.2f㎡ 대신 %.2f㎡ 대체 사용', {side}_primary_area, {side}_area)
   ELSE printf('{label}: 대표 전용 %.2f㎡ 사용', {side}_primary_area) END,
  CASE WHEN {side}_area <> {side}_primary_area THEN '{label}: 동일 대표면적 표본 부족으로 근접 타입 대체' END,
  CASE WHEN {side}_window = 0 THEN '{label}: 목표월 10층 이상 거래 사용' ELSE '{label}: ±' || {side}_window || '개월까지 확대' END,
  CASE WHEN {side}_samples <= 2 THEN '{label}: 정상거래 표본 ' || {side}_samples || '건' END,
  CASE WHEN {side}_outliers > 0 THEN '{label}: 주변 시세 흐름과 크게 벗어난 거래 ' || {side}_outliers || '건 제외' END"""


COMPARISON = f"""WITH {COMPLEX}, {SALE}, {ESTIMATES},
eligible AS (SELECT * FROM complex WHERE households >= 300 AND (far IS NULL OR far >= 100)),
joined AS (SELECT c.complex_id, name, region, {_side('s')}, {_side('e')}, e.value - s.value AS change, (e.value - s.value) / s.value * 100 AS rate,
    EXISTS (SELECT 1 FROM typed t WHERE t.complex_id = c.complex_id AND t.area_type = 59) AS has_area
  FROM eligible c LEFT JOIN (SELECT * FROM est WHERE side = 'start' AND area_type = 59) s USING (complex_id)
  LEFT JOIN (SELECT * FROM est WHERE side = 'end' AND area_type = 59) e USING (complex_id)),
named AS (SELECT complex_id, name, region, {', '.join(f'{p}_{f} AS {n}_{f}' for p, n in (('s', 'start'), ('e', 'end'))
    for f in ('value', 'low', 'high', 'samples', 'window', 'outliers', 'area', 'primary_area'))}, change, rate, has_area FROM joined),
graded AS (SELECT *, CASE WHEN change IS NULL THEN 1 ELSE greatest(1, 5 - {_penalty('start')} - {_penalty('end')}) END AS confidence,
    CASE WHEN change IS NULL AND has_area THEN 'no_trades_in_period' WHEN change IS NULL THEN 'no_trades_of_type' END AS missing,
    CASE WHEN change IS NULL THEN '10층 이상 실거래 표본이 부족해 정상 중층 매수가를 계산하지 못함'
      ELSE concat_ws(' / ', {_reasons('start', '과거')}, {_reasons('end', '현재')}) END AS reasons FROM named),
lined AS (SELECT * EXCLUDE (has_area), row_number() OVER (ORDER BY change DESC NULLS LAST, rate DESC NULLS LAST, name, complex_id) AS line FROM graded)
SELECT *, CASE WHEN change IS NOT NULL THEN line END AS rank FROM lined"""


@query("price_comparison", "E6 E7 W1 F9 P20", COMPARISON)
def price_comparison(star):
    return cmp.report_columns(cmp.ranked(cmp.compare(star.complexes, star.sales, FROM, TO)))

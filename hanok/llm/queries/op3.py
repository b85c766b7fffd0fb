from hanok.llm import mixing
from hanok.llm.registry import llm_query
from hanok.llm.tables import table


def _rounds(n: int) -> str:
    """Round k: among the documents left that fit, a prefix in hash order (equal hashes together) within the budget."""
    steps = []
    for k in range(n):
        steps.append(f"""
f{k} AS (SELECT d.*, b.budget AS fit, sum(CASE WHEN NOT d.chosen AND d.size > 0 AND d.size <= b.budget THEN d.size ELSE 0 END)
           OVER (PARTITION BY d.rank ORDER BY d.h) AS upto FROM d{k} d JOIN b{k} b USING (rank)),
d{k + 1} AS (SELECT rank, doc_id, size, h, chosen OR (size > 0 AND size <= fit AND upto <= fit) AS chosen FROM f{k}),
b{k + 1} AS (SELECT goal.rank, goal.budget - coalesce(sum(CASE WHEN chosen THEN size END), 0) AS budget
           FROM goal JOIN d{k + 1} USING (rank) GROUP BY goal.rank, goal.budget),""")
    return "".join(steps)


SQL = f"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM totals),
weighted AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM ranked),
sorted AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS ratio, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, rank) AS pos,
         coalesce(sum(2.0::DOUBLE * source_size) OVER o, 0) AS capped,
         sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS open,
         1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM weighted WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT coalesce(arg_min((total - capped) / open, pos) FILTER (WHERE (total - capped) / open < ratio), 0) AS level FROM sorted),
aimed AS (SELECT source, rank, source_size, least(2.0::DOUBLE * source_size, level * weight) AS target FROM weighted, water),
goal AS (SELECT *, CAST(floor(target / greatest(source_size, 1)) AS BIGINT) AS whole,
         target - floor(target / greatest(source_size, 1)) * source_size AS budget FROM aimed),
d0 AS (SELECT rank, doc_id, size, h, false AS chosen FROM s JOIN goal ON s.source IS NOT DISTINCT FROM goal.source),
b0 AS (SELECT rank, budget FROM goal),{_rounds(mixing.ROUNDS)}
final AS (SELECT d.doc_id, d.size, g.source, g.source_size, g.target,
            CASE WHEN d.size > 0 THEN g.whole + CASE WHEN chosen THEN 1 ELSE 0 END ELSE 0 END AS copies
          FROM d{mixing.ROUNDS} d JOIN goal g USING (rank))
SELECT doc_id, source, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM final
"""


@llm_query("op3_mixing", SQL)
def op3_mixing(spark, folder):
    return mixing.mix(table(spark, folder, "documents"))

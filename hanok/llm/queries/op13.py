from pyspark.sql import functions as F

from hanok.llm import periodic
from hanok.llm.registry import llm_query
from hanok.llm.tables import WORD, table

# the six words from each place are joined with themselves, as a run's matches are six in a row at least; CRC-32 bit by bit
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::BIGINT, 1))::BIGINT)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], range(0, 8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) AS h
  FROM documents),
p AS (SELECT r, doc_id, len(w) AS n, w, h % 10 = 0 AND len(w) > 0 AS tail, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM d),
q AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM p),
o AS (SELECT r, unnest(range(0, n)) AS i, unnest(w) AS x FROM q),
t AS (SELECT o.r, o.i, CASE WHEN o.x IS NULL THEN NULL ELSE o.x END AS x FROM o JOIN q USING (r) WHERE tail IS NOT TRUE OR i < a
  UNION ALL SELECT q.r, j, o.x FROM (SELECT r, a, p, unnest(range(a, n)) AS j FROM q WHERE tail) q JOIN o ON o.r = q.r AND o.i = q.a + (q.j - q.a) % q.p),
s AS (SELECT r, i, concat_ws(' ', x, lead(x, 1) OVER v, lead(x, 2) OVER v, lead(x, 3) OVER v, lead(x, 4) OVER v, lead(x, 5) OVER v) AS six,
  lead(x, 5) OVER v IS NOT NULL AS whole FROM t WINDOW v AS (PARTITION BY r ORDER BY i)),
m AS (SELECT b.r, b.i, b.i - a.i AS lag FROM s a JOIN s b ON a.r = b.r AND a.six = b.six AND a.i < b.i WHERE a.whole AND b.whole),
k AS (SELECT r, lag, i, i - row_number() OVER (PARTITION BY r, lag ORDER BY i) AS island FROM m),
st AS (SELECT r, lag, min(i) - lag AS start, max(i) + 6 - min(i) + lag AS length FROM k GROUP BY r, lag, island),
runs AS (SELECT r, start, length, min(lag) AS period FROM st WHERE length >= greatest(12, 2 * lag) GROUP BY r, start, length),
best AS (SELECT r, count(*) AS n_runs, arg_min(struct_pack(start, length, period), (-length, start, period)) AS z,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT t.r, string_agg(t.x, ' ' ORDER BY t.i) AS y FROM t ANTI JOIN gone ON t.r = gone.r AND t.i = gone.i GROUP BY t.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, z.start AS start, z.length AS length, z.period AS period, 1000 * z.length // z.period AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(y, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""


def with_periodic_tails(docs):
    """A tenth of the documents, by the CRC-32 of their id, with words from a given place on that repeat with a given period."""
    h, words = F.crc32(F.col("doc_id").cast("string")), F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    chosen = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.nullif(F.size("w"), F.lit(0)))
    placed = chosen.withColumn("a", (F.expr("h div 10") % F.col("n")).cast("int"))
    placed = placed.withColumn("p", F.expr("cast(1 + (n - a) div (3 + (h div 10) % 8) as int)"))
    period = F.slice("w", F.col("a") + 1, F.col("p"))
    times = F.expr("cast((n - a + p - 1) div p as int)")
    tail = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), F.col("n") - F.col("a"))
    text = F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text"))
    return placed.select("doc_id", text.alias("text"))


@llm_query("op13_periodic_runs", SQL)
def op13_periodic_runs(spark, folder):
    found = periodic.periodic_runs(with_periodic_tails(table(spark, folder, "documents")))
    least = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), least.alias("z"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select(
        "doc_id", "n_runs", F.col("z.start").alias("start"), (-F.col("z.length")).alias("length"), F.col("z.period").alias("period"),
        F.expr("1000 * -z.length div z.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )

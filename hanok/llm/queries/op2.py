from pyspark.sql import functions as F

from hanok.llm import repeats
from hanok.llm.registry import llm_query
from hanok.llm.tables import table

W = repeats.WINDOW

# windows by digest over hexadecimal text, cut from chunks of 256 starts so that no long text is scanned for each of them
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT r, c, substr(x, 512 * c + 1, 512 + {2 * W}) AS z FROM (SELECT r, x, unnest(range(0, (len(x) // 2 - {W} + 256) // 256)) AS c FROM d WHERE len(x) >= {2 * W})),
w AS (SELECT r, 256 * c + j AS i, md5(substr(z, 2 * j + 1, {2 * W})) AS m FROM (SELECT r, c, z, unnest(range(0, least(256, len(z) // 2 - {W - 1}))) AS j FROM c)),
s AS (SELECT r, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
g AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {W} THEN 0 ELSE 1 END AS new FROM s),
k AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM g),
spans AS (SELECT r, min(i) AS a, max(i) + {W} AS b FROM k GROUP BY r, run),
ends AS (SELECT r, a, b FROM spans UNION ALL SELECT r, len(x) // 2, NULL FROM d),
gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a, b NULLS LAST), 0) AS a, a AS b FROM ends),
kept AS (SELECT r, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS y FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, len(x) // 2 AS n_bytes, (len(x) - len(y)) // 2 AS n_removed,
  (SELECT count(*) FROM spans WHERE spans.r = d.r) AS n_spans, sha256(unhex(y)) AS kept_sha256
FROM d JOIN kept USING (r)
"""


@llm_query("op2_repeat_removal", SQL)
def op2_repeat_removal(spark, folder):
    found = repeats.remove_repeats(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("bigint").alias("n_removed"),
        F.size("removed_from").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )

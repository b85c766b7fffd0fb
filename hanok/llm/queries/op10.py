from hanok.llm import decontaminate
from hanok.llm.registry import llm_query
from hanok.llm.tables import table

# every alignment that shares enough words, without seeds
SQL = r"""
WITH item AS (SELECT min(item_id) AS item_id, ws FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM benchmark) WHERE len(ws) >= 5 GROUP BY ws),
doc AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
a AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM doc),
b AS (SELECT item_id, len(ws) AS n, least(13, len(ws)) AS size, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM item),
hit AS (SELECT a.doc_id, b.item_id, a.i - b.i AS shift, a.n AS n, b.n AS m, b.size, list(b.i) AS places FROM a JOIN b USING (w)
        GROUP BY ALL HAVING count(*) >= 0.8 * b.size),
win AS (SELECT *, unnest(range(greatest(0, -shift), least(m, n - shift) - size + 1)) AS s FROM hit),
cnt AS (SELECT doc_id, item_id, s, s + shift AS t, size, len(list_filter(places, lambda p: p >= s AND p < s + size)) AS n_equal FROM win),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, s, t) AS place FROM cnt WHERE n_equal >= 0.8 * size)
SELECT doc_id, item_id, CAST(t AS INT) AS doc_start, CAST(s AS INT) AS item_start, CAST(size AS INT) AS n_words, CAST(n_equal AS INT) AS n_equal FROM best WHERE place = 1
"""


@llm_query("op10_decontaminate", SQL)
def op10_decontaminate(spark, folder):
    return decontaminate.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))

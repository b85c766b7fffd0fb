from hanok.llm import phrases
from hanok.llm.registry import llm_query
from hanok.llm.tables import LOWER, UPPER, table

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
p AS (SELECT r, lang, generate_subscripts(x, 1) AS p, unnest(x) AS piece FROM (SELECT r, lang, string_split_regex(t, '[.,;:!?\\x0A-\\x0D]') AS x FROM d)),
w AS (SELECT r, lang, p, generate_subscripts(x, 1) AS i, unnest(x) AS w FROM (SELECT r, lang, p, regexp_extract_all(piece, '[^\\x20\\x09]+') AS x FROM p)),
g AS (SELECT lang, w AS w1, lead(w, 1) OVER v AS w2, lead(w, 2) OVER v AS w3 FROM w WINDOW v AS (PARTITION BY r, p ORDER BY i)),
one AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang),
two AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
inside AS (SELECT lang, w1, w2, max(f) AS most FROM (SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL),
cuts AS (
  SELECT two.lang, two.w1 || ' ' || two.w2 AS phrase, two.f AS a, 1 AS k, x.f AS l, y.f AS r FROM two
    JOIN one x ON two.lang = x.lang AND two.w1 = x.w1 JOIN one y ON two.lang = y.lang AND two.w2 = y.w1
    LEFT JOIN inside i ON two.lang = i.lang AND two.w1 = i.w1 AND two.w2 = i.w2 WHERE i.most IS NULL OR 100 * i.most < 50 * two.f
  UNION ALL SELECT z.lang, z.w1 || ' ' || z.w2 || ' ' || z.w3, z.f, 1, x.f, y.f FROM three z
    JOIN one x ON z.lang = x.lang AND z.w1 = x.w1 JOIN two y ON z.lang = y.lang AND z.w2 = y.w1 AND z.w3 = y.w2
  UNION ALL SELECT z.lang, z.w1 || ' ' || z.w2 || ' ' || z.w3, z.f, 2, x.f, y.f FROM three z
    JOIN two x ON z.lang = x.lang AND z.w1 = x.w1 AND z.w2 = x.w2 JOIN one y ON z.lang = y.lang AND z.w3 = y.w1),
scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


@llm_query("op11_phrases", SQL)
def op11_phrases(spark, folder):
    return phrases.collocations(table(spark, folder, "documents"))

from hanok.llm import exact_dedup
from hanok.llm.registry import llm_query
from hanok.llm.tables import LOWER, UPPER, table

SQL = f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""


@llm_query("op4_exact_dedup", SQL)
def op4_exact_dedup(spark, folder):
    return exact_dedup.group_copies(table(spark, folder, "documents"))

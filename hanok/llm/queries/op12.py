from hanok.llm import warc
from hanok.llm.registry import llm_query
from hanok.llm.tables import table
from hanok.session import scratch_path

SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT *, CASE WHEN payload_bytes >= {warc.REVISIT} THEN max(page_id) OVER (PARTITION BY payload_digest) END AS keep FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id IS DISTINCT FROM keep AND keep IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM g
"""


@llm_query("op12_warc", SQL)
def op12_warc(spark, folder):
    path = scratch_path(spark, "warc")
    warc.write(table(spark, folder, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

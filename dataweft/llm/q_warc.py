"""Query of the archives' round trip."""

from dataweft.llm import warc
from dataweft.llm.common import table
from dataweft.llm.queries import query

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
h AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS head FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM head AND head IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM head THEN head END AS refers_to
FROM h
"""


@query("op12_warc", WARC_SQL)
def op12_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))

"""Query of the ranked search."""

from dataweft.llm import maxscore
from dataweft.llm.common import table
from dataweft.llm.queries import query

#: The terms of a text: only A-Z lower-cased.
TERMS_SQL = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

RANKED_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, {TERMS_SQL} AS ts FROM documents WHERE text IS NOT NULL),
held AS (SELECT *, len(ts)::BIGINT AS n FROM docs WHERE len(ts) > 0),
totals AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM held),
items AS (SELECT row_number() OVER () AS i, item_id, {TERMS_SQL} AS ts FROM benchmark WHERE text IS NOT NULL),
asked AS (SELECT i, item_id, t, count(*)::BIGINT AS r FROM (SELECT i, item_id, unnest(ts) AS t FROM items) GROUP BY ALL),
freq AS (SELECT d, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT d, doc_id, n, unnest(ts) AS t FROM held) GROUP BY ALL),
df AS (SELECT t, count(*)::BIGINT AS df FROM freq GROUP BY t),
w AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, totals),
scored AS (
  SELECT i, item_id, d, doc_id, sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l))))::BIGINT AS score
  FROM asked JOIN freq USING (t) JOIN w USING (t), totals GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query("op13_ranked_search", RANKED_SQL)
def op13_ranked_search(spark, sf_dir):
    return maxscore.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

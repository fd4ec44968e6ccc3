"""Query of the source mix."""

from dataweft.llm import mixing
from dataweft.llm.common import table
from dataweft.llm.queries import query

SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, source_size * 3 AS most,
         row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rank FROM sources),
weighted AS (SELECT *, ([5.0, 2.0, 1.0])[(rank - 1) % 3 + 1]::DOUBLE AS weight FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
fixed AS (SELECT arg_min(level, (most / weight, rank)) AS level FROM levels WHERE level * weight < most),
goals AS (
  SELECT l.source, l.source_size,
         CASE WHEN f.level * l.weight < l.most THEN f.level * l.weight ELSE l.most::DOUBLE END AS target
  FROM levels l LEFT JOIN fixed f ON true),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END AS copies,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.digest, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (copies * size + least(greatest(floor(target + 0.5)::BIGINT - copies * source_size - before, 0), size))::BIGINT AS taken
FROM placed
"""


@query("op3_source_mix", SQL)
def op3_source_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")

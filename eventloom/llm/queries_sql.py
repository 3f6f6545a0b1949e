"""SQL twins of the queries in this folder, for those that SQL can express."""

OP1_MIXING = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':'
              || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source
), filling AS (
  SELECT *,
         3 * sum(source_size) OVER ()
           - 2 * coalesce(sum(2 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
         2 * sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS below
  FROM totals
  WINDOW w AS (ORDER BY 2 * source_size / weight, source NULLS LAST)
), level AS (
  SELECT arg_min(above, 2 * source_size / weight) AS above, arg_min(below, 2 * source_size / weight) AS below
  FROM filling WHERE weight * above < 2 * source_size * below
), targets AS (
  SELECT source, source_size,
         CAST(CASE WHEN level.below IS NULL OR weight * level.above >= 2 * source_size * level.below
              THEN 2 * source_size ELSE weight * level.above END AS BIGINT) AS above,
         CAST(CASE WHEN level.below IS NULL OR weight * level.above >= 2 * source_size * level.below
              THEN 1 ELSE level.below END AS BIGINT) AS below
  FROM totals, level
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN above // (below * source_size) ELSE 0 END AS passes
  FROM targets
), ranked AS (
  SELECT s.doc_id, s.size, b.source_size, b.above / b.below AS target, b.passes,
         b.above // b.below - b.passes * b.source_size AS budget,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h) AS BIGINT) AS until,
         CAST(sum(s.size) OVER (PARTITION BY s.source, s.h) AS BIGINT) AS inside
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * (passes + CASE WHEN until <= budget
            OR (until - inside <= budget AND 2 * (budget - (until - inside)) >= inside) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranked
"""

OP6_WARC = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS payload_bytes
  FROM pages
), grouped AS (
  SELECT *, CASE WHEN payload_bytes >= 1000
       THEN max(page_id) OVER (PARTITION BY payload) END AS original
  FROM payloads
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN original <> page_id OR (original IS NOT NULL AND page_id IS NULL)
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN original <> page_id OR (original IS NOT NULL AND page_id IS NULL)
            THEN original END AS refers_to
FROM grouped
"""

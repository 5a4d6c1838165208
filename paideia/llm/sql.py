"""DuckDB SQL for those queries of this subpackage that SQL can express."""

OP6 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, CAST(source_size * 2 AS DOUBLE) AS cap,
         CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w
  FROM by_source
), levels AS (
  SELECT *, cap / w AS ratio, row_number() OVER o AS place,
         (CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER b, CAST(0 AS DOUBLE)))
         / (sum(w) OVER () - coalesce(sum(w) OVER b, CAST(0 AS DOUBLE))) AS level
  FROM weighted
  WINDOW o AS (ORDER BY cap / w, source NULLS LAST),
         b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), free AS (
  SELECT min(place) AS place, arg_min(level, place) AS level FROM levels WHERE level <= ratio
), targets AS (
  SELECT l.source, l.source_size, CASE WHEN f.place IS NULL OR l.place < f.place THEN l.cap ELSE l.w * f.level END AS target
  FROM levels l CROSS JOIN free f
), queued AS (
  SELECT s.doc_id, s.source, s.size, s.h, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS served
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), offered AS (
  SELECT q.*, e.epoch, (CAST(e.epoch * q.source_size + q.served AS DOUBLE)) / q.target AS finish
  FROM queued q CROSS JOIN (VALUES (0), (1)) e(epoch)
  WHERE q.size > 0 AND q.target > 0
), cut AS (
  SELECT *, sum(size) OVER (ORDER BY finish, h, epoch, doc_id, served ROWS UNBOUNDED PRECEDING) AS upto FROM offered
), taken AS (
  SELECT doc_id, source, served, count(*) AS copies FROM cut
  WHERE upto <= (SELECT CAST(sum(size) AS DOUBLE) * CAST(1.5 AS DOUBLE) FROM sized) GROUP BY ALL
)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(t.copies, 0) AS BIGINT) AS taken
FROM queued q LEFT JOIN taken t
  ON q.size > 0 AND q.doc_id = t.doc_id AND q.served = t.served AND q.source IS NOT DISTINCT FROM t.source
"""

OP10 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

ORACLE_SQL = {"op6_source_mixing": OP6, "op10_exact_dedup": OP10}

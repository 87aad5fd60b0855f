"""Query of the line template operator."""

from pyspark.sql import functions as F

from framelark.llm.common import read
from framelark.llm.line_templates import drop_templates
from framelark.llm.registry import query

LINES_SQL = r"""
WITH parts AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM parts),
tokens AS (
  SELECT doc_id, line_no, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'),
    lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS t FROM lines),
leafed AS (SELECT *, len(t) AS n, t[1:2] AS head FROM tokens WHERE len(t) >= 3),
leaves AS (
  SELECT n, head FROM leafed GROUP BY n, head HAVING count(DISTINCT doc_id) >= 3),
busy AS (
  SELECT t, n, head, count(DISTINCT doc_id) AS docs,
    min({'doc': doc_id, 'line_no': line_no}) AS place
  FROM leafed JOIN leaves USING (n, head) GROUP BY t, n, head),
cells AS (SELECT *, unnest(range(len(t))) AS pos, unnest(t) AS token FROM busy),
constant AS (
  SELECT n, head, pos, token FROM cells WHERE token <> '<*>'
  GROUP BY n, head, pos, token HAVING sum(docs) >= 3),
held AS (
  SELECT t, list({'pos': pos, 'token': token} ORDER BY pos) AS held
  FROM cells JOIN constant USING (n, head, pos, token) GROUP BY t),
found AS (SELECT * FROM busy JOIN held USING (t) WHERE len(held) >= 0.6 * n),
groups AS (
  SELECT n, head, held, min(place) AS first FROM found GROUP BY n, head, held
  HAVING sum(docs) >= 3),
gone AS (
  SELECT l.doc_id, l.line_no FROM leafed l JOIN found f ON l.t = f.t
  JOIN groups g ON g.n = f.n AND g.head = f.head AND g.held = f.held
  WHERE NOT (l.doc_id = g.first.doc AND l.line_no = g.first.line_no)),
left_over AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS kept, count(*) AS n_kept
  FROM lines ANTI JOIN gone USING (doc_id, line_no) GROUP BY doc_id)
SELECT p.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(ls), 0) - coalesce(n_kept, 0) AS BIGINT) AS n_dropped,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM parts p LEFT JOIN left_over USING (doc_id)
"""


@query("op1_line_templates", LINES_SQL)
def line_templates(spark, sf_dir):
    return drop_templates(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))

"""Queries of the sharding and mixing operators."""

from pyspark.sql import functions as F

from framelark.llm.common import read
from framelark.llm.external_shuffle import external_shuffle
from framelark.llm.registry import query
from framelark.llm.source_mixing import mix

MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    ('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r
  FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][r % 3 + 1] AS w FROM sums),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0) AS DOUBLE)
      / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS level,
    row_number() OVER (ORDER BY source_size / w, r) AS turn
  FROM weighed
  WINDOW b AS (ORDER BY source_size / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (
  SELECT arg_min(level, turn) AS level FROM levels WHERE level * w <= 3 * source_size),
targets AS (
  SELECT l.source, l.source_size,
    least(CAST(3 * l.source_size AS DOUBLE),
      coalesce(c.level * l.w, CAST(3 * l.source_size AS DOUBLE))) AS target
  FROM levels l, chosen c),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END
      AS whole FROM targets),
hashes AS (SELECT source, h, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY source, h),
running AS (
  SELECT *, CAST(sum(words) OVER (PARTITION BY source ORDER BY h) AS BIGINT) AS through
  FROM hashes),
edges AS (
  SELECT r.source, arg_min(r.h, r.h) FILTER (r.through > b.target - b.whole * b.source_size) AS cut,
    max(r.h) AS last
  FROM running r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source GROUP BY r.source),
edge AS (
  SELECT e.source, r.h AS edge, r.words - (b.target - b.whole * b.source_size - r.through + r.words)
      < (b.target - b.whole * b.source_size - r.through + r.words) AS with_edge
  FROM edges e JOIN running r
    ON r.source IS NOT DISTINCT FROM e.source AND r.h = coalesce(e.cut, e.last)
  JOIN budgets b ON b.source IS NOT DISTINCT FROM e.source)
SELECT s.doc_id, s.size, b.source_size, b.target,
  s.size * (b.whole + CASE WHEN s.h < e.edge OR s.h = e.edge AND e.with_edge THEN 1 ELSE 0 END)
    AS taken
FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
JOIN edge e ON s.source IS NOT DISTINCT FROM e.source
"""


@query("op3_mix_sources", MIX_SQL)
def mix_sources(spark, sf_dir):
    return mix(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


@query("op6_external_shuffle")
def shuffled_shards(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    return external_shuffle(docs, 8, size).select(
        "doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )

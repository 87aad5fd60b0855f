"""Queries of the operators that compare documents with others or a benchmark."""

from pyspark.sql import functions as F

from framelark.llm import fm_index, repeat_intervals
from framelark.llm.common import read
from framelark.llm.overlap_join import near_duplicates
from framelark.llm.registry import query
from framelark.llm.spaced_seeds import contaminated

#: Two substitutions leave four of thirteen tokens in a row, so here runs of
#: four tokens find the candidates.
SEEDS_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'),
    lambda x: x <> '') AS t FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'),
    lambda x: x <> '') AS t FROM benchmark),
dp AS (SELECT doc_id, t, unnest(range(1, len(t) - 2)) AS i FROM d),
bp AS (SELECT item_id, t, unnest(range(1, len(t) - 2)) AS j FROM b WHERE len(t) >= 13),
diagonals AS (
  SELECT DISTINCT dp.doc_id, bp.item_id, dp.i - bp.j AS shift
  FROM dp JOIN bp ON dp.t[dp.i] = bp.t[bp.j] AND dp.t[dp.i + 1] = bp.t[bp.j + 1]
    AND dp.t[dp.i + 2] = bp.t[bp.j + 2] AND dp.t[dp.i + 3] = bp.t[bp.j + 3]),
starts AS (
  SELECT x.doc_id, x.item_id, x.shift, unnest(range(1, len(b.t) - 11)) AS j
  FROM diagonals x JOIN b USING (item_id)),
windows AS (
  SELECT s.doc_id, s.item_id, s.j + s.shift AS place,
    list_sum(list_transform(range(0, 13), lambda k: CAST(d.t[s.j + s.shift + k] = b.t[s.j + k] AS INT)))
      AS same
  FROM starts s JOIN d USING (doc_id) JOIN b USING (item_id)
  WHERE s.j + s.shift >= 1 AND s.j + s.shift + 12 <= len(d.t))
SELECT doc_id, item_id, count(DISTINCT place) AS n_windows, CAST(max(same) AS BIGINT) AS best
FROM windows WHERE same >= 11 GROUP BY doc_id, item_id
"""


@query("op7_spaced_seeds", SEEDS_SQL)
def spaced_seeds(spark, sf_dir):
    docs, benchmark = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return contaminated(docs, benchmark, F.col("doc_id")).withColumnRenamed("key", "doc_id")


@query("op10_overlap_join")
def overlap_join(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id")


@query("op4_fm_index")
def repeated_words(spark, sf_dir):
    return fm_index.drop_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed",
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op8_repeat_intervals")
def repeated_bytes(spark, sf_dir):
    return repeat_intervals.drop_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))

"""Queries of exact dedup, lexical search and embedding whitening."""

from pyspark.sql import functions as F

from framelark.llm.common import read
from framelark.llm.extendible_index import exact_duplicates
from framelark.llm.registry import query
from framelark.llm.stratified_index import ranked_search
from framelark.llm.whitening import whiten

EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""


@query("op13_extendible_index", EXACT_SQL)
def extendible_index(spark, sf_dir):
    return exact_duplicates(read(spark, sf_dir, "documents"))


SEARCH_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT doc_id, t, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
whole AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sizes),
normed AS (SELECT doc_id, t, 100 - 25 + ((25 * n * nn) // ll) AS m FROM sizes, whole),
tokens AS (SELECT doc_id, m, unnest(t) AS term FROM normed),
postings AS (SELECT doc_id, m, term, count(*) AS tf FROM tokens GROUP BY doc_id, m, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM postings, whole GROUP BY term, nn),
items AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS repeats FROM items GROUP BY item_id, term),
scored AS (
  SELECT item_id, doc_id,
    CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank,
    doc_id, score FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query("op12_stratified_search", SEARCH_SQL)
def stratified_search(spark, sf_dir):
    return ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op11_embedding_whitening")
def embedding_whitening(spark, sf_dir):
    pair = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "pair")
    return whiten(read(spark, sf_dir, "embeddings")).select(
        "vec_id", "n", "deviation", "identity_error", pair,
    ).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation",
        F.col("pair.whitened").alias("whitened"), F.col("pair.explained").alias("explained"),
        "identity_error")

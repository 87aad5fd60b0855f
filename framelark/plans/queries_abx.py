"""Queries: ABX counts, scores and their summary."""

from pyspark.sql import functions as F

from framelark.operators import abx
from framelark.operators import phones as ph
from framelark.plans import stand_ins as si
from framelark.plans.queries_corpus import _ITEMS, _round3
from framelark.plans.registry import query, r6
from framelark.plans.stand_ins import with_views


@query("abx_counts", with_views("fx_frames", "fx_phones") + f""", {_ITEMS}
SELECT a.phone AS phone_1, b.phone AS phone_2, a.context, a.speaker, count(*) AS n
FROM fx_items a
JOIN fx_items x ON a.context = x.context AND a.speaker = x.speaker AND a.phone = x.phone
     AND (a.utt <> x.utt OR a.phone_ix <> x.phone_ix)
JOIN fx_items b ON a.context = b.context AND a.speaker = b.speaker AND a.phone <> b.phone
GROUP BY ALL""")
def abx_counts(spark, sf_dir):
    """Triplets per phone pair, context and speaker."""
    phones = si.phones(spark, sf_dir, si.stored_frames(spark, sf_dir))
    return abx.triplet_counts(ph.items(phones))


_SCORES = with_views("fx_vec") + """,
unit AS (SELECT utt * 10 + frame_ix AS item, label AS phone, speaker, feats,
                sqrt(list_dot_product(feats, feats)) AS norm FROM fx_vec),
dist AS (SELECT x.item, x.phone AS phone_1, o.phone AS phone_2, x.speaker,
                round(1 - list_dot_product(x.feats, o.feats) / (x.norm * o.norm), 12) AS d
         FROM unit x JOIN unit o ON x.speaker = o.speaker AND x.item <> o.item),
trip AS (SELECT a.phone_1, b.phone_2, a.speaker, CASE WHEN a.d < b.d THEN 1 WHEN a.d = b.d THEN 0.5 ELSE 0 END AS s
         FROM dist a JOIN dist b ON a.item = b.item
         WHERE a.phone_2 = a.phone_1 AND b.phone_2 <> b.phone_1),
scores AS (SELECT phone_1, phone_2, speaker, avg(s) AS score, count(*) AS n FROM trip GROUP BY ALL)"""


def _vector_tokens(spark, sf_dir):
    return si.vectors(spark, sf_dir).select(
        (F.col("utt") * 10 + F.col("frame_ix")).alias("item"), F.col("label").alias("phone"),
        "speaker", "feats", F.lit(1).alias("n_frames"),
    )


@query("abx_scores", _SCORES + """
SELECT phone_1, phone_2, speaker, round(score, 6) + 0.0 AS score, n FROM scores""")
def abx_scores(spark, sf_dir):
    """Labelled vectors as single-frame tokens, discriminated within speakers."""
    rows = abx.abx_scores(_vector_tokens(spark, sf_dir), 64, by=["speaker"])
    return rows.withColumn("score", r6("score"))


@query("abx_collapse", _SCORES + """
SELECT least(phone_1, phone_2)::VARCHAR || '_' || greatest(phone_1, phone_2)::VARCHAR AS phones,
       round(sum(score * n) / sum(n), 6) + 0.0 AS score, CAST(sum(n) AS BIGINT) AS n FROM scores GROUP BY ALL""")
def abx_collapse(spark, sf_dir):
    scores = abx.abx_scores(_vector_tokens(spark, sf_dir), 64, by=["speaker"])
    rows = abx.collapsed(scores)
    return rows.withColumn("score", r6("score"))


RATE = 200 / 7 / 2

# At this rate a phone spans at most two frames, so the best alignment of two
# tokens is the diagonal, or all pairs if one of them has a single frame.
_DTW = with_views("fx_frames", "fx_phones") + f""", {_ITEMS},
it AS (SELECT utt, phone_ix, phone, context, speaker, {_round3("onset")} AS a, {_round3("offset_s")} AS b FROM fx_items),
tf AS (SELECT i.utt, i.phone_ix, phone, context, i.speaker, c0 / sqrt(c0 * c0 + c1 * c1) AS u, c1 / sqrt(c0 * c0 + c1 * c1) AS v,
              row_number() OVER (PARTITION BY i.utt, i.phone_ix ORDER BY f.frame_ix) AS k,
              count(*) OVER (PARTITION BY i.utt, i.phone_ix) AS m
       FROM it i JOIN fx_frames f ON f.utt = i.utt AND f.frame_ix BETWEEN ceil(a * {RATE!r}::DOUBLE) AND floor(b * {RATE!r}::DOUBLE)),
dist AS (SELECT x.utt, x.phone_ix, o.utt AS ou, o.phone_ix AS op, x.phone AS phone_1, o.phone AS phone_2, x.context, x.speaker,
                round(avg(1 - (x.u * o.u + x.v * o.v)), 12) AS d
         FROM tf x JOIN tf o ON x.context = o.context AND x.speaker = o.speaker
              AND (x.utt <> o.utt OR x.phone_ix <> o.phone_ix) AND (x.m = 1 OR o.m = 1 OR x.k = o.k)
         GROUP BY ALL)"""


@query("abx_dtw", _DTW + """
SELECT a.phone_1, b.phone_2, a.context, a.speaker,
       round(avg(CASE WHEN a.d < b.d THEN 1 WHEN a.d = b.d THEN 0.5 ELSE 0 END), 6) + 0.0 AS score, count(*) AS n
FROM dist a JOIN dist b ON a.utt = b.utt AND a.phone_ix = b.phone_ix
WHERE a.phone_2 = a.phone_1 AND b.phone_2 <> b.phone_1 GROUP BY ALL""")
def abx_dtw(spark, sf_dir):
    """Phones of the events as tokens of one or more frames, aligned in time."""
    frames = si.stored_frames(spark, sf_dir)
    items = ph.items(si.phones(spark, sf_dir, frames))
    tokens = abx.tokens(items, frames, sampling_rate=RATE)
    return abx.abx_scores(tokens, 2).withColumn("score", r6("score"))

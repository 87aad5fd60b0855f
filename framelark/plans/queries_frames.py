"""Queries: windows on the frame grid, batches, moments, normalisation."""

from pyspark.sql import functions as F

from framelark.operators import channels as ch
from framelark.operators import frames as fr
from framelark.operators import moments as mo
from framelark.plans import stand_ins as si
from framelark.plans.registry import channels, query, r6
from framelark.plans.stand_ins import with_views


def _clamped(expr: str, k: int) -> str:
    """SQL for the value ``k`` frames away with the edge value repeated."""
    if k < 0:
        edge = f"first_value({expr}) OVER wf"
        return f"CASE WHEN frame_ix + ({k}) < 0 THEN {edge} ELSE lag({expr}, {-k}) OVER w END"
    edge = f"last_value({expr}) OVER wf"
    return f"CASE WHEN frame_ix + {k} > n - 1 THEN {edge} ELSE lead({expr}, {k}) OVER w END"


def _sql_delta(expr: str) -> str:
    terms = [f"{k} * (({_clamped(expr, k)}) - ({_clamped(expr, -k)}))" for k in range(1, 6)]
    return f"({' + '.join(terms)}) / 110"


_WINDOWS = """WINDOW w AS (PARTITION BY utt ORDER BY frame_ix),
  wf AS (PARTITION BY utt ORDER BY frame_ix ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
_COUNTED = "fx_n AS (SELECT *, count(*) OVER (PARTITION BY utt) AS n FROM fx_frames)"


@query("simple_difference", with_views("fx_frames") + f""", {_COUNTED}
SELECT utt, frame_ix, round(({_clamped('c0', 3)}) - ({_clamped('c0', -3)}), 6) + 0.0 AS d0,
       round(({_clamped('c1', 3)}) - ({_clamped('c1', -3)}), 6) + 0.0 AS d1
FROM fx_n {_WINDOWS}""")
def simple_difference(spark, sf_dir):
    rows = fr.simple_difference(si.frames(spark, sf_dir), lag=3, width=2)
    return rows.select("utt", "frame_ix", *channels("d", 2))


@query("delta", with_views("fx_frames") + f""", {_COUNTED}
SELECT utt, frame_ix, round({_sql_delta('c0')}, 6) + 0.0 AS d0, round({_sql_delta('c1')}, 6) + 0.0 AS d1
FROM fx_n {_WINDOWS}""")
def delta(spark, sf_dir):
    return fr.delta(si.frames(spark, sf_dir), width=2).select(
        "utt", "frame_ix", *channels("d", 2)
    )


_DYNAMIC = f""", {_COUNTED},
fx_d AS (SELECT utt, speaker, frame_ix, n, c0, c1, {_sql_delta('c0')} AS d0, {_sql_delta('c1')} AS d1
         FROM fx_n {_WINDOWS}),
fx_dyn AS (SELECT utt, speaker, frame_ix, n, c0, c1, d0, d1, {_sql_delta('d0')} AS dd0, {_sql_delta('d1')} AS dd1
           FROM fx_d {_WINDOWS})"""


@query("dynamic_features", with_views("fx_frames") + _DYNAMIC + """
SELECT utt, frame_ix, round(c0, 6) + 0.0 AS f0, round(c1, 6) + 0.0 AS f1, round(d0, 6) + 0.0 AS f2,
       round(d1, 6) + 0.0 AS f3, round(dd0, 6) + 0.0 AS f4, round(dd1, 6) + 0.0 AS f5
FROM fx_dyn""")
def dynamic_features(spark, sf_dir):
    return fr.dynamic_features(si.frames(spark, sf_dir), width=2).select(
        "utt", "frame_ix", *channels("f", 6)
    )


@query("context_window_zero", with_views("fx_frames") + "SELECT utt, frame_ix, " + ", ".join(
    f"round(coalesce(lag(c{c}, {2 - i}) OVER w, 0), 6) + 0.0 AS f{2 * i + c}"
    for i in range(5) for c in range(2)
) + " FROM fx_frames WINDOW w AS (PARTITION BY utt ORDER BY frame_ix)")
def context_window_zero(spark, sf_dir):
    rows = fr.context_windows(si.frames(spark, sf_dir), width=2, window=2)
    return rows.select("utt", "frame_ix", *channels("f", 10))


@query("context_window_edge", with_views("fx_frames") + f""", {_COUNTED}
SELECT utt, CAST(frame_ix - 5 AS INT) AS frame_ix, f0, f10, f21 FROM (
  SELECT utt, frame_ix, n, round(lag(c0, 5) OVER w, 6) + 0.0 AS f0, round(c0, 6) + 0.0 AS f10,
         round(lead(c1, 5) OVER w, 6) + 0.0 AS f21 FROM fx_n
  WINDOW w AS (PARTITION BY utt ORDER BY frame_ix)) t
WHERE frame_ix >= 5 AND frame_ix < n - 5""")
def context_window_edge(spark, sf_dir):
    rows = fr.context_windows(
        si.frames(spark, sf_dir), width=2, window=5, zero_padding=False
    )
    return rows.select(
        "utt", "frame_ix", *[r6(F.get("feats", F.lit(i))).alias(f"f{i}") for i in (0, 10, 21)]
    )


@query("crop_edges", with_views("fx_frames") + f""", {_COUNTED}
SELECT utt, CAST(frame_ix - 5 AS INT) AS frame_ix, round(c0, 6) + 0.0 AS f0, round(c1, 6) + 0.0 AS f1
FROM fx_n WHERE frame_ix >= 5 AND frame_ix < n - 5""")
def crop_edges(spark, sf_dir):
    return fr.crop_edges(si.frames(spark, sf_dir), 5).select(
        "utt", "frame_ix", *channels("f", 2)
    )


@query("delta_matrix", with_views("fx_frames") + """,
ln AS (SELECT utt, count(*) AS n FROM fx_frames GROUP BY utt),
cell AS (SELECT utt, n, unnest(generate_series(0, n - 1)) AS t FROM ln),
term AS (SELECT utt, t, least(greatest(t + k, 0), n - 1) AS s, k
         FROM cell, (SELECT unnest(generate_series(-5, 5)) AS k) kk WHERE k <> 0)
SELECT utt, CAST(t AS INT) AS t, CAST(s AS INT) AS s, round(sum(k) / 110, 9) + 0.0 AS w
FROM term GROUP BY utt, t, s""")
def delta_matrix(spark, sf_dir):
    rows = fr.delta_matrix(fr.lengths(si.frames(spark, sf_dir)))
    return rows.withColumn("w", F.round("w", 9) + F.lit(0.0))


@query("lowpass_fir", with_views("fx_frames") + "SELECT utt, frame_ix, " + ", ".join(
    "round(" + " + ".join(
        f"coalesce(lag({c}, {5 - i}) OVER w, 0) * CAST({h!r} AS DOUBLE)"
        for i, h in enumerate(fr.fir_taps(cut, 200, 5))
    ) + f", 6) + 0.0 AS {out}" for c, cut, out in (("c0", 20, "f0"), ("c1", 35, "f1"))
) + " FROM fx_frames WINDOW w AS (PARTITION BY utt ORDER BY frame_ix)")
def lowpass_fir(spark, sf_dir):
    rows = fr.lowpass_fir(si.frames(spark, sf_dir), [20, 35], width=2)
    return rows.select("utt", "frame_ix", *channels("f", 2))


_PADDED = """,
ln AS (SELECT utt, CAST(count(*) AS INT) AS length FROM fx_frames GROUP BY utt),
grid AS (SELECT utt, length, unnest(generate_series(0, (SELECT max(length) FROM ln) - 1)) AS frame_ix FROM ln),
pad AS (SELECT g.utt, CAST(g.frame_ix AS INT) AS frame_ix, g.length, coalesce(f.c0, 0) AS c0, coalesce(f.c1, 0) AS c1
        FROM grid g LEFT JOIN fx_frames f ON f.utt = g.utt AND f.frame_ix = g.frame_ix)"""


@query("pad_batch", with_views("fx_frames") + _PADDED + """
SELECT utt, frame_ix, length, round(c0, 6) + 0.0 AS f0, round(c1, 6) + 0.0 AS f1 FROM pad""")
def pad_batch(spark, sf_dir):
    rows = fr.padded_batch(si.frames(spark, sf_dir), width=2)
    return rows.select("utt", "frame_ix", "length", *channels("f", 2))


@query("unpad_batch", with_views("fx_frames") + """
SELECT utt, frame_ix, round(c0, 6) + 0.0 AS f0, round(c1, 6) + 0.0 AS f1 FROM fx_frames""")
def unpad_batch(spark, sf_dir):
    batch = fr.padded_batch(si.frames(spark, sf_dir), width=2)
    return fr.unpadded(batch).select("utt", "frame_ix", *channels("f", 2))


@query("pack_batch", with_views("fx_frames") + """,
ln AS (SELECT utt, CAST(least(count(*), 64) AS INT) AS length FROM fx_frames GROUP BY utt),
grid AS (SELECT utt, length, unnest(generate_series(0, 63)) AS i FROM ln)
SELECT g.utt, g.length, CAST(g.i AS INT) AS frame_ix, round(coalesce(f.c0, 0), 6) + 0.0 AS f0,
       round(coalesce(f.c1, 0), 6) + 0.0 AS f1
FROM grid g LEFT JOIN fx_frames f ON f.utt = g.utt AND f.frame_ix = g.i""")
def pack_batch(spark, sf_dir):
    batch = fr.packed_batch(si.frames(spark, sf_dir), width=2, length=64)
    rows = batch.select("utt", "length", F.posexplode("feats").alias("frame_ix", "feats"))
    return rows.select("utt", "length", "frame_ix", *channels("f", 2))


@query("masked_mean", with_views("fx_frames") + """
SELECT utt, round(avg(c0), 6) + 0.0 AS mean FROM fx_frames GROUP BY utt""")
def masked_mean(spark, sf_dir):
    """Means of all frames, out of a batch padded to the longest utterance."""
    batch = fr.sequence_mask(fr.padded_batch(si.frames(spark, sf_dir), width=2))
    x = F.get("feats", F.lit(0)) * F.col("mask")
    return batch.groupBy("utt").agg(r6(F.sum(x) / F.sum("mask")).alias("mean"))


# --- moments and normalisation ---------------------------------------------

# File means of two-decimal values can be exact halves of the sixth decimal, and
# the two engines add in different orders: the nudge keeps both on one side.
_MOMENTS = """count(value) AS n, round(avg(value) + 1e-9, 6) + 0.0 AS mean,
  round(stddev_pop(value), 6) + 0.0 AS std, round(max(value) - min(value), 6) + 0.0 AS spread"""


def _moment_columns():
    return [
        "n", r6(F.col("mean") + 1e-9).alias("mean"),
        *[r6(c).alias(c) for c in ("std", "spread")],
    ]


@query("moments_file", with_views("fx_frames", "fx_long") + f"""
SELECT speaker, utt, channel, {_MOMENTS} FROM fx_long GROUP BY speaker, utt, channel""")
def moments_file(spark, sf_dir):
    return mo.moments(si.frames(spark, sf_dir), "file").select(
        "speaker", "utt", "channel", *_moment_columns()
    )


@query("moments_speaker", with_views("fx_frames", "fx_long") + f"""
SELECT speaker, channel, {_MOMENTS} FROM fx_long GROUP BY speaker, channel""")
def moments_speaker(spark, sf_dir):
    return mo.moments(si.frames(spark, sf_dir), "speaker").select(
        "speaker", "channel", *_moment_columns()
    )


@query("moments_corpus", with_views("fx_vec", "fx_vlong") + f"""
SELECT channel, {_MOMENTS} FROM fx_vlong GROUP BY channel""")
def moments_corpus(spark, sf_dir):
    return mo.moments(si.vectors(spark, sf_dir), "corpus").select(
        "channel", *_moment_columns()
    )


@query("moments_all_scopes", with_views("fx_frames", "fx_long") + f"""
SELECT 'file' AS scope, speaker, utt, channel, {_MOMENTS} FROM fx_long GROUP BY speaker, utt, channel
UNION ALL SELECT 'speaker', speaker, NULL, channel, {_MOMENTS} FROM fx_long GROUP BY speaker, channel
UNION ALL SELECT 'corpus', NULL, NULL, channel, {_MOMENTS} FROM fx_long GROUP BY channel""")
def moments_all_scopes(spark, sf_dir):
    return mo.all_scopes(si.frames(spark, sf_dir)).select(
        "scope", "speaker", "utt", "channel", *_moment_columns()
    )


@query("normalize_stds_corpus", with_views("fx_vec", "fx_vlong") + """
SELECT utt, frame_ix, channel, round((value - avg(value) OVER c) / nullif(stddev_pop(value) OVER c, 0), 6) + 0.0 AS value
FROM fx_vlong WINDOW c AS (PARTITION BY channel)""")
def normalize_stds_corpus(spark, sf_dir):
    rows = mo.normalize(si.vectors(spark, sf_dir), "stds", "corpus", width=64)
    return fr.long_form(rows, "utt", "frame_ix").withColumn("value", r6("value"))


@query("normalize_spread_speaker", with_views("fx_frames", "fx_long") + """
SELECT utt, frame_ix, channel,
       round((value - avg(value) OVER c) / nullif(max(value) OVER c - min(value) OVER c, 0), 6) + 0.0 AS value
FROM fx_long WINDOW c AS (PARTITION BY speaker, channel)""")
def normalize_spread_speaker(spark, sf_dir):
    rows = mo.normalize(si.frames(spark, sf_dir), "spread", "speaker", width=2)
    return fr.long_form(rows, "utt", "frame_ix").withColumn("value", r6("value"))


@query("normalize_stds_file", with_views("fx_frames", "fx_long") + """
SELECT utt, frame_ix, channel, round((value - avg(value) OVER c) / nullif(stddev_pop(value) OVER c, 0), 6) + 0.0 AS value
FROM fx_long WINDOW c AS (PARTITION BY utt, channel)""")
def normalize_stds_file(spark, sf_dir):
    rows = mo.normalize(si.frames(spark, sf_dir), "stds", "file", width=2)
    return fr.long_form(rows, "utt", "frame_ix").withColumn("value", r6("value"))


@query("demean", with_views("fx_frames", "fx_long") + """
SELECT utt, frame_ix, channel, round(value - avg(value) OVER (PARTITION BY speaker, channel), 6) + 0.0 AS value
FROM fx_long""")
def demean(spark, sf_dir):
    rows = mo.demean(si.frames(spark, sf_dir), "speaker", width=2)
    return fr.long_form(rows, "utt", "frame_ix").withColumn("value", r6("value"))


@query("denormalize", with_views("fx_frames", "fx_long") + """
SELECT utt, frame_ix, channel, round(value * stddev_pop(value) OVER (PARTITION BY channel), 6) + 0.0 AS value
FROM fx_long""")
def denormalize(spark, sf_dir):
    frames = si.frames(spark, sf_dir)
    rows = mo.with_moments(frames, mo.moments(frames, "corpus"), "corpus")
    rows = mo.denormalize(rows, F.col("_divs"), width=2)
    return fr.long_form(rows, "utt", "frame_ix").withColumn("value", r6("value"))


@query("normalized_dynamics", with_views("fx_frames") + _DYNAMIC + """
SELECT utt, frame_ix, """ + ", ".join(
    f"round(({c} - avg({c}) OVER s) / nullif(stddev_pop({c}) OVER s, 0), 6) + 0.0 AS f{i}"
    for i, c in enumerate(["c0", "c1", "d0", "d1", "dd0", "dd1"])
) + " FROM fx_dyn WINDOW s AS (PARTITION BY speaker)")
def normalized_dynamics(spark, sf_dir):
    """Static, delta and delta-delta features, standardised per speaker."""
    rows = fr.dynamic_features(si.frames(spark, sf_dir), width=2)
    rows = mo.normalize(rows, "stds", "speaker", width=6)
    return rows.select("utt", "frame_ix", *channels("f", 6))


# --- channels ---------------------------------------------------------------


@query("select_channels", with_views("fx_vec") + """
SELECT utt, frame_ix, round(feats[4], 6) + 0.0 AS f0, round(feats[2], 6) + 0.0 AS f1, round(feats[64], 6) + 0.0 AS f2
FROM fx_vec""")
def select_channels(spark, sf_dir):
    names = [f"v{i}" for i in range(64)]
    rows = ch.select_channels(si.vectors(spark, sf_dir), names, ["v3", "v1", "v63"])
    return rows.select("utt", "frame_ix", *channels("f", 3))


@query("scale_units", with_views("fx_frames") + """
SELECT utt, frame_ix, round(c0 / 1000, 6) + 0.0 AS f0, round(c1 / 1000, 6) + 0.0 AS f1 FROM fx_frames""")
def scale_units(spark, sf_dir):
    rows = ch.scale(si.frames(spark, sf_dir), 1 / 1000, width=2)
    return rows.select("utt", "frame_ix", *channels("f", 2))


@query("concat_features", with_views("fx_frames") + """
SELECT utt, frame_ix, round(c0, 6) + 0.0 AS f0, round(c1, 6) + 0.0 AS f1,
       round(c1 * 2, 6) + 0.0 AS f2, round(c0 * 2, 6) + 0.0 AS f3 FROM fx_frames""")
def concat_features(spark, sf_dir):
    frames = si.frames(spark, sf_dir).select("utt", "frame_ix", "feats")
    other = frames.withColumn(
        "feats", F.array(F.get("feats", F.lit(1)) * 2, F.get("feats", F.lit(0)) * 2)
    )
    return ch.concat_features(frames, other).select("utt", "frame_ix", *channels("f", 4))


@query("interlace", with_views("fx_frames") + """
SELECT utt, frame_ix, CASE WHEN c1 > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f0, round(c0, 6) + 0.0 AS f1,
       CASE WHEN c1 > 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f2, round(c1, 6) + 0.0 AS f3 FROM fx_frames""")
def interlace(spark, sf_dir):
    c1 = F.get("feats", F.lit(1))
    binary = F.array((c1 > 50).cast("double"), (c1 > 25).cast("double"))
    rows = ch.interlace(si.frames(spark, sf_dir), binary, 2, [0, 2])
    return rows.select("utt", "frame_ix", *channels("f", 4))

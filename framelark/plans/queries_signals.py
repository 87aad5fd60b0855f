"""Queries: framing, energy, prediction, cepstra, gaps, filters, rates.

The tables hold no audio: the values of each user's events stand for a signal.
"""

import numpy as np
from pyspark.sql import functions as F

from framelark.functions import kernels
from framelark.operators import signals as sg
from framelark.plans import stand_ins as si
from framelark.plans.registry import channels, query, r6
from framelark.plans.stand_ins import TRACKS, with_views

L, H = 16, 8


def _signal(spark, sf_dir):
    """c0 as one long signal per utterance, in blocks of 32 samples."""
    rows = si.frames(spark, sf_dir).select(
        "utt", F.col("frame_ix").alias("sample_ix"), F.get("feats", F.lit(0)).alias("value")
    )
    return sg.blocks(rows, block=32)


_FRAMED = with_views("fx_frames") + f""",
ln AS (SELECT utt, count(*) AS n FROM fx_frames GROUP BY utt),
marks AS (SELECT utt, n, unnest(generate_series(0, (n - {L}) // {H})) AS f FROM ln WHERE n >= {L}),
fx_framed AS (SELECT m.utt, CAST(f AS INT) AS frame_ix, frame_ix - f * {H} AS i, c0 AS x
              FROM marks m JOIN fx_frames s ON s.utt = m.utt AND s.frame_ix BETWEEN f * {H} AND f * {H} + {L - 1})"""

# Centred frames on the signal mirrored at both ends.
_CENTRED = with_views("fx_frames") + f""",
ln AS (SELECT utt, count(*) AS n FROM fx_frames GROUP BY utt),
marks AS (SELECT utt, n, unnest(generate_series(0, n // {H})) AS f FROM ln),
taps AS (SELECT utt, n, f, i, f * {H} - {L // 2} + i AS s FROM marks, (SELECT unnest(generate_series(0, {L - 1})) AS i) ii),
fx_framed AS (SELECT t.utt, CAST(f AS INT) AS frame_ix, i, c0 AS x FROM taps t JOIN fx_frames s
  ON s.utt = t.utt AND s.frame_ix = CASE WHEN t.s < 0 THEN -t.s WHEN t.s >= n THEN 2 * (n - 1) - t.s ELSE t.s END)"""


@query("framing", _FRAMED + """
SELECT utt, frame_ix, CAST(i AS INT) AS i, round(x, 6) + 0.0 AS x FROM fx_framed""")
def framing(spark, sf_dir):
    rows = sg.framed(_signal(spark, sf_dir), L, H, block=32)
    return rows.select("utt", "frame_ix", F.posexplode("feats").alias("i", "x")).withColumn(
        "x", r6("x")
    )


@query("frame_rms", _FRAMED + """
SELECT utt, frame_ix, round(sqrt(avg(x * x)), 6) + 0.0 AS rms FROM fx_framed GROUP BY utt, frame_ix""")
def frame_rms(spark, sf_dir):
    rows = sg.rms_energy(_signal(spark, sf_dir), L, H, centred=False, block=32)
    return rows.select("utt", "frame_ix", r6(F.get("feats", F.lit(0))).alias("rms"))


@query("frame_rms_centred", _CENTRED + """
SELECT utt, frame_ix, round(sqrt(avg(x * x)), 6) + 0.0 AS rms FROM fx_framed GROUP BY utt, frame_ix""")
def frame_rms_centred(spark, sf_dir):
    rows = sg.rms_energy(_signal(spark, sf_dir), L, H, centred=True, block=32)
    return rows.select("utt", "frame_ix", r6(F.get("feats", F.lit(0))).alias("rms"))


_LPC3 = _FRAMED + """,
pairs AS (SELECT a.utt, a.frame_ix, b.i - a.i AS lag, a.x * b.x AS xx FROM fx_framed a JOIN fx_framed b
          ON a.utt = b.utt AND a.frame_ix = b.frame_ix AND b.i - a.i BETWEEN 0 AND 3),
ac AS (SELECT utt, frame_ix, sum(xx) FILTER (WHERE lag = 0) AS r0, sum(xx) FILTER (WHERE lag = 1) AS r1,
              sum(xx) FILTER (WHERE lag = 2) AS r2, sum(xx) FILTER (WHERE lag = 3) AS r3 FROM pairs GROUP BY utt, frame_ix),
s1 AS (SELECT *, r1 / r0 AS k1, r0 * (1 - (r1 / r0) * (r1 / r0)) AS e1 FROM ac),
s2 AS (SELECT *, (r2 - k1 * r1) / e1 AS k2 FROM s1),
s3 AS (SELECT *, k1 - k2 * k1 AS b1, k2 AS b2, e1 * (1 - k2 * k2) AS e2 FROM s2),
s4 AS (SELECT *, (r3 - b1 * r2 - b2 * r1) / e2 AS k3 FROM s3),
lpc AS (SELECT utt, frame_ix, b1 - k3 * b2 AS a1, b2 - k3 * b1 AS a2, k3 AS a3 FROM s4)"""


@query("lpc", _LPC3 + f""",
err AS (SELECT f.utt, f.frame_ix, f.i, f.x
          - a1 * lag(f.x, 1) OVER w - a2 * lag(f.x, 2) OVER w - a3 * lag(f.x, 3) OVER w AS e
        FROM fx_framed f JOIN lpc USING (utt, frame_ix) WINDOW w AS (PARTITION BY f.utt, f.frame_ix ORDER BY f.i))
SELECT l.utt, l.frame_ix, round(max(a1), 6) + 0.0 AS f0, round(max(a2), 6) + 0.0 AS f1, round(max(a3), 6) + 0.0 AS f2,
       round(sqrt(avg(e * e)), 6) + 0.0 AS f3
FROM lpc l JOIN err USING (utt, frame_ix) WHERE i >= 3 GROUP BY l.utt, l.frame_ix""")
def lpc(spark, sf_dir):
    frames = sg.framed(_signal(spark, sf_dir), L, H, block=32)
    return sg.lpc_with_error(frames, L, 3).select("utt", "frame_ix", *channels("f", 4))


_ANGLE = "CASE WHEN {0} >= 1 THEN 0 WHEN {0} <= -1 THEN pi() ELSE acos({0}) END"


@query("lsf", _LPC3 + f""",
co AS (SELECT utt, frame_ix, -(a2 / a1 - a3 / a1 + 1) / 2 AS p, -(a2 / a1 + a3 / a1 - 1) / 2 AS q FROM lpc),
an AS (SELECT utt, frame_ix, {_ANGLE.format('p')} AS p, {_ANGLE.format('q')} AS q FROM co)
SELECT utt, frame_ix, round(least(p, q), 6) + 0.0 AS f0, round(greatest(p, q), 6) + 0.0 AS f1 FROM an""")
def lsf(spark, sf_dir):
    frames = sg.framed(_signal(spark, sf_dir), L, H, block=32)
    return sg.lsf_frames(frames, L, 2).select("utt", "frame_ix", *channels("f", 2))


@query("lsf_to_lpc", with_views("fx_frames") + """,
an AS (SELECT utt, frame_ix, pi() * c0 / (c0 + c1 + 1) AS a, pi() * (c0 + c1) / (c0 + c1 + 1) AS b FROM fx_frames)
SELECT utt, frame_ix, 1.0::DOUBLE AS f0, round(-cos(a) - cos(b), 6) + 0.0 AS f1,
       round(1 + cos(b) - cos(a), 6) + 0.0 AS f2
FROM an""")
def lsf_to_lpc(spark, sf_dir):
    """Two increasing angles per frame, made from its two values."""
    c0, c1 = F.get("feats", F.lit(0)), F.get("feats", F.lit(1))
    angles = F.array(F.pi() * c0 / (c0 + c1 + 1), F.pi() * (c0 + c1) / (c0 + c1 + 1))
    frames = si.frames(spark, sf_dir).select("utt", "frame_ix", angles.alias("feats"))
    return sg.lsf_to_lpc(frames, 2).select("utt", "frame_ix", *channels("f", 3))


N_MELS, N_MFCC, RATE = 6, 4, 16000


def _values(matrix: np.ndarray) -> str:
    cells = ", ".join(
        f"({i}, {j}, {float(v)!r}::DOUBLE)" for (i, j), v in np.ndenumerate(matrix)
    )
    return f"(VALUES {cells})"


@query("mfcc", _CENTRED + f""",
hann AS (SELECT utt, frame_ix, i, x * (0.5 - 0.5 * cos(2 * pi() * i / {L})) AS x FROM fx_framed),
dft AS (SELECT utt, frame_ix, k, sum(x * cos(2 * pi() * i * k / {L})) AS re, sum(x * sin(2 * pi() * i * k / {L})) AS im
        FROM hann, (SELECT unnest(generate_series(0, {L // 2})) AS k) kk GROUP BY utt, frame_ix, k),
bank AS (SELECT * FROM {_values(kernels.mel_bank(RATE, L, N_MELS))} AS t(m, k, w)),
db AS (SELECT utt, frame_ix, m, 10 * log10(greatest(sum(w * (re * re + im * im)), 1e-10)) AS v
       FROM dft JOIN bank USING (k) GROUP BY utt, frame_ix, m),
cut AS (SELECT utt, frame_ix, m, greatest(v, max(v) OVER (PARTITION BY utt) - 80) AS v FROM db),
cep AS (SELECT utt, frame_ix, c, sum(v * cos(pi() * c * (m + 0.5) / {N_MELS})) * sqrt(2.0 / {N_MELS})
               / CASE WHEN c = 0 THEN sqrt(2.0) ELSE 1 END AS v
        FROM cut, (SELECT unnest(generate_series(0, {N_MFCC - 1})) AS c) cc GROUP BY utt, frame_ix, c)
SELECT utt, frame_ix, """ + ", ".join(
    f"round(max(v) FILTER (WHERE c = {c}), 6) + 0.0 AS f{c}" for c in range(N_MFCC)
) + " FROM cep GROUP BY utt, frame_ix")
def mfcc(spark, sf_dir):
    frames = sg.framed(_signal(spark, sf_dir), L, H, centred=True, block=32)
    rows = sg.mfcc_frames(frames, L, RATE, N_MFCC, N_MELS)
    return rows.select("utt", "frame_ix", *channels("f", N_MFCC))


# --- gaps, filters, rates ---------------------------------------------------


def _holes(spark, sf_dir, feats):
    """Frames of 'error' events lose their first channel."""
    frames = si.frames(spark, sf_dir)
    first = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(
        F.get(feats, F.lit(0))
    )
    return frames.select(
        "utt", "frame_ix", F.array(first, F.get(feats, F.lit(1))).alias("feats")
    )


# The spline by elimination along the knots: one recursion each way.
_SPLINE = "WITH RECURSIVE" + with_views("fx_frames")[4:] + """,
knots AS (SELECT utt, frame_ix, CAST(frame_ix AS DOUBLE) AS x, c0 AS y,
                 row_number() OVER (PARTITION BY utt ORDER BY frame_ix) - 1 AS j, count(*) OVER (PARTITION BY utt) AS m
          FROM fx_frames WHERE event_type <> 'error'),
seg AS (SELECT utt, j, m, x, y, lead(x) OVER w - x AS h, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS s
        FROM knots WINDOW w AS (PARTITION BY utt ORDER BY j)),
rw AS (SELECT b.utt, b.j, b.m, a.h AS h0, b.h AS h1, a.h / (a.h + b.h) AS lo0, b.h / (a.h + b.h) AS hi0,
              6 * (b.s - a.s) / (a.h + b.h) AS r
       FROM seg a JOIN seg b ON a.utt = b.utt AND b.j = a.j + 1 WHERE b.j <= b.m - 2),
sys AS (SELECT utt, j, m, r, h0, h1, CASE WHEN j = m - 2 THEN lo0 - hi0 * (h1 / h0) ELSE lo0 END AS lo,
               CASE WHEN j = 1 THEN hi0 - lo0 * (h0 / h1) ELSE hi0 END AS hi,
               2 + CASE WHEN j = 1 THEN lo0 * (1 + h0 / h1) ELSE 0 END
                 + CASE WHEN j = m - 2 THEN hi0 * (1 + h1 / h0) ELSE 0 END AS dg FROM rw),
fwd AS (SELECT utt, j, hi / dg AS u, r / dg AS o FROM sys WHERE j = 1
        UNION ALL SELECT s.utt, s.j, s.hi / (s.dg - s.lo * f.u), (s.r - s.lo * f.o) / (s.dg - s.lo * f.u)
        FROM fwd f JOIN sys s ON s.utt = f.utt AND s.j = f.j + 1),
back AS (SELECT f.utt, f.j, f.o AS m2 FROM fwd f JOIN sys s ON s.utt = f.utt AND s.j = f.j WHERE s.j = s.m - 2
         UNION ALL SELECT f.utt, f.j, f.o - f.u * b.m2 FROM back b JOIN fwd f ON f.utt = b.utt AND f.j = b.j - 1),
curv AS (SELECT utt, j, m2 FROM back
         UNION ALL SELECT s.utt, 0, a.m2 + (s.h0 / s.h1) * (a.m2 - b.m2) FROM sys s
           JOIN back a ON a.utt = s.utt AND a.j = 1 JOIN back b ON b.utt = s.utt AND b.j = 2 WHERE s.j = 1
         UNION ALL SELECT s.utt, s.m - 1, a.m2 + (s.h1 / s.h0) * (a.m2 - b.m2) FROM sys s
           JOIN back a ON a.utt = s.utt AND a.j = s.m - 2 JOIN back b ON b.utt = s.utt AND b.j = s.m - 3 WHERE s.j = s.m - 2),
poly AS (SELECT s.utt, s.j, s.x, s.y, s.s - s.h * (2 * a.m2 + b.m2) / 6 AS b, a.m2 / 2 AS c, (b.m2 - a.m2) / (6 * s.h) AS d
         FROM seg s JOIN curv a ON a.utt = s.utt AND a.j = s.j JOIN curv b ON b.utt = s.utt AND b.j = s.j + 1),
gaps AS (SELECT utt, frame_ix, greatest(least(seen - 1, m - 2), 0) AS j FROM (
  SELECT utt, frame_ix, event_type, count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY utt ORDER BY frame_ix) AS seen,
         count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY utt) AS m FROM fx_frames) t WHERE event_type = 'error')"""


@query("spline_fill", _SPLINE + """
SELECT utt, frame_ix, round(c0, 4) + 0.0 AS f0 FROM fx_frames WHERE event_type <> 'error'
UNION ALL SELECT g.utt, g.frame_ix, round(y + (g.frame_ix - x) * (b + (g.frame_ix - x) * (c + (g.frame_ix - x) * d)), 4) + 0.0
FROM gaps g JOIN poly p ON p.utt = g.utt AND p.j = g.j""")
def spline_fill(spark, sf_dir):
    rows = sg.fill_gaps(_holes(spark, sf_dir, F.col("feats")), width=2)
    first = F.round(F.get("feats", F.lit(0)), 4) + F.lit(0.0)
    return rows.select("utt", "frame_ix", first.alias("f0"))


@query("spline_fill_cubic", with_views("fx_frames") + """
SELECT utt, frame_ix, round(0.001::DOUBLE * frame_ix * frame_ix * frame_ix - 0.05::DOUBLE * frame_ix * frame_ix + utt % 10, 6) + 0.0 AS f0,
       round(c1, 6) + 0.0 AS f1 FROM fx_frames""")
def spline_fill_cubic(spark, sf_dir):
    """A cubic of the frame number with holes: the spline must give it back."""
    t = F.col("frame_ix")
    cubic = 0.001 * t * t * t - 0.05 * t * t + F.col("utt") % 10
    feats = F.array(cubic, F.get("feats", F.lit(1)))
    rows = sg.fill_gaps(_holes(spark, sf_dir, feats), width=2)
    return rows.select("utt", "frame_ix", *channels("f", 2))


def _impulse_response(order: int, cutoff: float, rate: float, n: int) -> np.ndarray:
    """By the difference equation, for the SQL twin."""
    zeros, poles, gain = kernels.butterworth(order, cutoff, rate)
    b, a = gain * np.real(np.poly(zeros)), np.real(np.poly(poles))
    h = np.zeros(n)
    for i in range(n):
        h[i] = b[i] if i < len(b) else 0.0
        h[i] -= sum(a[j] * h[i - j] for j in range(1, min(i, order) + 1))
    return h


_H = _impulse_response(5, 20, 100, 160)


@query("butter_filtfilt", with_views("fx_frames") + f""",
h AS (SELECT * FROM (VALUES {", ".join(f"({k}, {float(v)!r}::DOUBLE)" for k, v in enumerate(_H))}) AS t(k, h)),
ln AS (SELECT utt, count(*) AS n FROM fx_frames GROUP BY utt),
grid AS (SELECT utt, n, unnest(generate_series(0, n + 35)) AS e FROM ln),
ext AS (SELECT g.utt, g.n, g.e,
          CASE WHEN e < 18 THEN 2 * a.c0 - s.c0 WHEN e >= n + 18 THEN 2 * z.c0 - s.c0 ELSE s.c0 END AS x
        FROM grid g
        JOIN fx_frames s ON s.utt = g.utt AND s.frame_ix =
             CASE WHEN e < 18 THEN 18 - e WHEN e >= n + 18 THEN 2 * n - 2 - (e - 18) ELSE e - 18 END
        JOIN fx_frames a ON a.utt = g.utt AND a.frame_ix = 0
        JOIN fx_frames z ON z.utt = g.utt AND z.frame_ix = n - 1),
f AS (SELECT g.utt, g.n, g.e, sum(h.h * s.x) AS x FROM grid g, h, ext s
      WHERE s.utt = g.utt AND s.e = greatest(g.e - h.k, 0) GROUP BY g.utt, g.n, g.e),
b AS (SELECT g.utt, g.e, sum(h.h * s.x) AS x FROM grid g, h, f s
      WHERE s.utt = g.utt AND s.e = least(g.e + h.k, g.n + 35) AND g.e >= 18 AND g.e < g.n + 18 GROUP BY g.utt, g.e)
SELECT utt, CAST(e - 18 AS INT) AS frame_ix, round(x, 6) + 0.0 AS f0 FROM b""")
def butter_filtfilt(spark, sf_dir):
    rows = sg.lowpass_filter(
        si.frames(spark, sf_dir).select("utt", "frame_ix", "feats"), 20, 100, width=2
    )
    return rows.select("utt", "frame_ix", *channels("f", 1))


@query("resample_fft", with_views("fx_frames") + """,
ln AS (SELECT utt, count(*) AS n, CAST(floor(count(*) * 0.4::DOUBLE) AS BIGINT) AS m FROM fx_frames GROUP BY utt),
bins AS (SELECT utt, n, m, unnest(generate_series(0, m // 2)) AS k FROM ln),
spec AS (SELECT b.utt, b.n, b.m, b.k, sum(c0 * cos(2 * pi() * k * frame_ix / b.n)) AS re,
                -sum(c0 * sin(2 * pi() * k * frame_ix / b.n)) AS im
         FROM bins b JOIN fx_frames f ON f.utt = b.utt GROUP BY b.utt, b.n, b.m, b.k),
outs AS (SELECT utt, unnest(generate_series(0, m - 1)) AS t FROM ln)
SELECT o.utt, CAST(t AS INT) AS frame_ix,
  round(sum(CASE WHEN k = 0 THEN 1 ELSE 2 END * (re * cos(2 * pi() * k * t / m) - CASE WHEN 2 * k = m THEN 0 ELSE im END * sin(2 * pi() * k * t / m)) / n), 6) + 0.0 AS f0
FROM outs o JOIN spec s ON s.utt = o.utt GROUP BY o.utt, t""")
def resample_fft(spark, sf_dir):
    """From 250 to 100 frames per second."""
    rows = sg.resample(si.frames(spark, sf_dir), 250, 100, width=2)
    return rows.select("utt", "frame_ix", *channels("f", 1))


@query("resample_long_tracks", TRACKS + """,
ln AS (SELECT utt, count(*) AS n, CAST(floor(count(*) * 0.4::DOUBLE) AS BIGINT) AS m FROM tracks GROUP BY utt),
bins AS (SELECT utt, n, m, unnest(generate_series(0, m // 2)) AS k FROM ln),
spec AS (SELECT b.utt, b.n, b.m, b.k, sum(c0 * cos(2 * pi() * ((k * frame_ix) % b.n) / b.n)) AS re,
                -sum(c0 * sin(2 * pi() * ((k * frame_ix) % b.n) / b.n)) AS im
         FROM bins b JOIN tracks f ON f.utt = b.utt GROUP BY b.utt, b.n, b.m, b.k),
outs AS (SELECT utt, unnest(generate_series(0, m - 1)) AS t FROM ln)
SELECT o.utt, CAST(t AS INT) AS frame_ix,
  round(sum(CASE WHEN k = 0 THEN 1 ELSE 2 END * (re * cos(2 * pi() * ((k * t) % m) / m)
    - CASE WHEN 2 * k = m THEN 0 ELSE im END * sin(2 * pi() * ((k * t) % m) / m)) / n), 6) + 0.0 AS f0
FROM outs o JOIN spec s ON s.utt = o.utt GROUP BY o.utt, t""")
def resample_long_tracks(spark, sf_dir):
    """Tracks of several lengths, all too long for a task at this limit."""
    rows = sg.resample(si.tracks(spark, sf_dir), 250, 100, width=2, whole_limit=100)
    return rows.select("utt", "frame_ix", *channels("f", 1))

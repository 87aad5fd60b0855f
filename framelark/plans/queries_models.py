"""Queries: scores, model application, mixture readouts."""

import numpy as np
from pyspark.sql import functions as F

from framelark.functions import scalars as sl
from framelark.functions.vectors import softmax
from framelark.operators import frames as fr
from framelark.operators import models as md
from framelark.operators import scoring as sc
from framelark.operators import training as tr
from framelark.operators import trajectory as tj
from framelark.plans import stand_ins as si
from framelark.plans.queries_frames import _WINDOWS, _sql_delta
from framelark.plans.registry import channels, query, r6
from framelark.plans.stand_ins import with_views

_VOICED = "CASE WHEN event_type IN ('click', 'purchase') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
_SCORED = with_views("fx_frames") + f""",
scored AS (
  SELECT utt, speaker, frame_ix, 0 AS channel, c0 + 10 * sin(event_id::DOUBLE) AS p, c0 AS t FROM fx_frames
  UNION ALL SELECT utt, speaker, frame_ix, 1, c1 * 0.9::DOUBLE, c1 FROM fx_frames
  UNION ALL SELECT utt, speaker, frame_ix, 2, 1 / (1 + exp(-(c0 - 100) / 50)), {_VOICED} FROM fx_frames)"""
_CE = "-(t * ln(p + 1e-32) + (1 - t) * ln((1 - p) + 1e-32))"


def _scored(spark, sf_dir):
    """Three predicted channels, the last one binary, in long form."""
    frames = si.frames(spark, sf_dir)
    c0, c1 = F.get("feats", F.lit(0)), F.get("feats", F.lit(1))
    voiced = F.when(F.col("event_type").isin("click", "purchase"), 1.0).otherwise(0.0)
    proba = 1 / (1 + F.exp(-(c0 - 100) / 50))
    predicted = F.array(c0 + 10 * F.sin(F.col("event_id").cast("double")), c1 * 0.9, proba)
    return sc.paired(
        frames.withColumn("feats", predicted),
        frames.withColumn("feats", F.array(c0, c1, voiced)),
    )


def _frame_scores(spark, sf_dir):
    return _scored(spark, sf_dir).where(F.col("channel") == 2)


@query("rmse_utterance", _SCORED + """
SELECT utt, channel, round(sqrt(avg((p - t) * (p - t))), 6) + 0.0 AS rmse FROM scored GROUP BY utt, channel""")
def rmse_utterance(spark, sf_dir):
    return sc.rmse_utterance(_scored(spark, sf_dir)).withColumn("rmse", r6("rmse"))


@query("rmse_corpus", _SCORED + f"""
SELECT channel, count(*) AS n,
       round(CASE WHEN channel = 2 THEN avg({_CE}) ELSE sqrt(avg((p - t) * (p - t))) END, 6) + 0.0 AS score
FROM scored GROUP BY channel""")
def rmse_corpus(spark, sf_dir):
    rows = sc.score_corpus(_scored(spark, sf_dir), binary=[2])
    return rows.withColumn("score", r6("score"))


@query("rmse_corpus_truncated", _SCORED + """
SELECT channel, count(*) AS n, round(sqrt(avg((p - t) * (p - t))), 6) + 0.0 AS score
FROM scored WHERE frame_ix < 50 GROUP BY channel""")
def rmse_corpus_truncated(spark, sf_dir):
    rows = sc.score_corpus(_scored(spark, sf_dir), max_length=50)
    return rows.withColumn("score", r6("score"))


@query("rmse_blocks", _SCORED + """
SELECT CASE WHEN channel < 1 THEN 'encoder' ELSE 'decoder' END AS block, channel, count(*) AS n,
       round(sqrt(avg((p - t) * (p - t))), 6) + 0.0 AS score FROM scored GROUP BY block, channel""")
def rmse_blocks(spark, sf_dir):
    rows = sc.score_blocks(_scored(spark, sf_dir), n_channels=3, n_input=2)
    return rows.withColumn("score", r6("score"))


def _rounded_scores(rows):
    return rows.withColumns({c: r6(c) for c in ("accuracy", "cross_entropy")})


@query("binary_scores", _SCORED + f"""
SELECT utt, round(avg(CASE WHEN round_even(p, 0) = t THEN 1 ELSE 0 END), 6) + 0.0 AS accuracy,
       round(avg({_CE}), 6) + 0.0 AS cross_entropy, count(*) AS n FROM scored WHERE channel = 2 GROUP BY utt""")
def binary_scores(spark, sf_dir):
    return _rounded_scores(sc.binary_scores(_frame_scores(spark, sf_dir), ["utt"]))


@query("label_scores", f"""
WITH s AS (SELECT lang, 1 / (1 + exp(-(n_chars - 1000) / 500.0::DOUBLE)) AS p, quality::DOUBLE AS t
           FROM documents JOIN labels USING (doc_id))
SELECT lang, round(avg(CASE WHEN round_even(p, 0) = t THEN 1 ELSE 0 END), 6) + 0.0 AS accuracy,
       round(avg({_CE}), 6) + 0.0 AS cross_entropy, count(*) AS n FROM s GROUP BY lang""")
def label_scores(spark, sf_dir):
    docs = si.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rows = docs.join(si.table(spark, sf_dir, "labels"), "doc_id").select(
        "lang", (1 / (1 + F.exp(-(F.col("n_chars") - 1000) / 500))).alias("p"),
        F.col("quality").cast("double").alias("t"),
    )
    return _rounded_scores(sc.binary_scores(rows, ["lang"]))


@query("sequence_scores", _SCORED + f""",
seq AS (SELECT utt, avg(p) AS p, (utt % 2)::DOUBLE AS t FROM scored WHERE channel = 2 GROUP BY utt)
SELECT round(avg(CASE WHEN round_even(p, 0) = t THEN 1 ELSE 0 END), 6) + 0.0 AS accuracy,
       round(avg({_CE}), 6) + 0.0 AS cross_entropy, count(*) AS n FROM seq""")
def sequence_scores(spark, sf_dir):
    rows = _frame_scores(spark, sf_dir).withColumn("t", (F.col("utt") % 2).cast("double"))
    return _rounded_scores(sc.sequence_scores(rows))


@query("finite_mean", with_views("fx_frames") + """
SELECT utt, round(avg(c0) FILTER (WHERE frame_ix % 5 <> 0 AND frame_ix % 7 <> 0), 6) + 0.0 AS mean
FROM fx_frames GROUP BY utt""")
def finite_mean(spark, sf_dir):
    """Every fifth value replaced by NaN and every seventh by infinity."""
    x = F.get("feats", F.lit(0))
    x = F.when(F.col("frame_ix") % 5 == 0, F.lit(float("nan"))).when(
        F.col("frame_ix") % 7 == 0, F.lit(float("inf"))
    ).otherwise(x)
    rows = si.frames(spark, sf_dir).select("utt", x.alias("x"))
    return sc.finite_mean(rows, "x", ["utt"]).withColumn("mean", r6("mean"))


# --- models -----------------------------------------------------------------


def layer(n_in: int, n_out: int, number: int, activation: str) -> md.Dense:
    """Weights sin(7i + j + 3l) / 8 and biases cos(j + l) / 10."""
    i, j = np.indices((n_in, n_out))
    return md.Dense(
        np.sin(7.0 * i + j + 3 * number) / 8, np.cos(np.arange(n_out) + number) / 10, activation
    )


def _sql_layer(source: str, n_out: int, number: int, act: str) -> str:
    """One dense layer over long rows ``(utt, frame_ix, i, x)`` -> ``(.., i, x)``."""
    pre = f"sum(x * sin(7 * i::DOUBLE + j + {3 * number}) / 8) + cos(j::DOUBLE + {number}) / 10"
    body = act.replace("?", pre)
    return (
        f"(SELECT utt, frame_ix, j AS i, {body} AS x FROM {source}, "
        f"(SELECT unnest(generate_series(0, {n_out - 1})) AS j) jj GROUP BY utt, frame_ix, j)"
    )


def _pivoted(source: str, names: list[str]) -> str:
    cells = ", ".join(
        f"round(max(x) FILTER (WHERE i = {i}), 6) + 0.0 AS {n}" for i, n in enumerate(names)
    )
    return f"SELECT utt, frame_ix, {cells} FROM {source} GROUP BY utt, frame_ix"


def _model(n_in: int) -> md.DenseModel:
    return md.DenseModel(
        [layer(n_in, 8, 1, "relu")], layer(8, 4, 2, "identity"),
        layer(8, 1, 3, "sigmoid"), (1,),
    )


_HIDDEN = "greatest(?, 0)"


@query("dense_forward", with_views("fx_vec", "fx_vlong") + f""",
x0 AS (SELECT utt, frame_ix, channel AS i, value AS x FROM fx_vlong),
h AS {_sql_layer('x0', 8, 1, _HIDDEN)},
o AS {_sql_layer('h', 4, 2, '?')},
b AS {_sql_layer('h', 1, 3, '1 / (1 + exp(-(?)))')},
lay AS (SELECT utt, frame_ix, CASE WHEN i >= 1 THEN i + 1 ELSE i END AS i, x FROM o
        UNION ALL SELECT utt, frame_ix, 1, round_even(x, 0) FROM b)
""" + _pivoted("lay", ["y0", "y1", "y2", "y3", "y4"]))
def dense_forward(spark, sf_dir):
    rows = md.dense_forward(si.vectors(spark, sf_dir), _model(64))
    return rows.select("utt", "frame_ix", *channels("y", 5))


@query("invert", with_views("fx_vec", "fx_vlong") + f""",
ctx AS (SELECT a.utt, a.frame_ix, b.channel + 64 * (b.frame_ix - a.frame_ix + 1) AS i, b.value AS x
        FROM fx_vec a JOIN fx_vlong b ON a.utt = b.utt AND b.frame_ix BETWEEN a.frame_ix - 1 AND a.frame_ix + 1),
h AS {_sql_layer('ctx', 8, 1, _HIDDEN)},
o AS {_sql_layer('h', 4, 2, '?')},
kept AS (SELECT utt, frame_ix, CASE i WHEN 3 THEN 0 ELSE 1 END AS i, x FROM o WHERE i IN (0, 3))
""" + _pivoted("kept", ["y0", "y1"]))
def invert(spark, sf_dir):
    """Prediction from three frames of context; channels 4 and 0 are kept."""
    rows = md.invert(
        si.vectors(spark, sf_dir), _model(3 * 64), width=64, context=1, channels=[4, 0]
    )
    return rows.select("utt", "frame_ix", *channels("y", 2))


def _fir(c: str) -> str:
    return " + ".join(
        f"coalesce(lag({c}, {5 - i}) OVER w, 0) * CAST({h!r} AS DOUBLE)"
        for i, h in enumerate(fr.fir_taps(20, 200, 5))
    )


@query("refine_signal", with_views("fx_frames") + f""",
sc AS (SELECT utt, frame_ix, c0 * 2 AS a, c1 * 0.5::DOUBLE AS b, count(*) OVER (PARTITION BY utt) AS n FROM fx_frames),
s AS (SELECT utt, frame_ix, n, {_fir('a')} AS a, {_fir('b')} AS b FROM sc
      WINDOW w AS (PARTITION BY utt ORDER BY frame_ix)),
d AS (SELECT utt, frame_ix, n, a, b, {_sql_delta('a')} AS da, {_sql_delta('b')} AS db FROM s {_WINDOWS})
SELECT utt, frame_ix, round(a, 6) + 0.0 AS f0, round(b, 6) + 0.0 AS f1, round(da, 6) + 0.0 AS f2,
       round(db, 6) + 0.0 AS f3, round({_sql_delta('da')}, 6) + 0.0 AS f4, round({_sql_delta('db')}, 6) + 0.0 AS f5
FROM d {_WINDOWS}""")
def refine_signal(spark, sf_dir):
    rows = md.refine_signal(
        si.frames(spark, sf_dir), 2, norms=[2, 0.5], cutoffs=20, add_dynamic=True
    )
    return rows.select("utt", "frame_ix", *channels("f", 6))


@query("activations", with_views("fx_vec") + """,
x AS (SELECT utt, frame_ix, feats[1] * 10 AS a, feats[2] * 10 AS b, feats[3] * 10 AS c FROM fx_vec)
SELECT utt, frame_ix, round(a, 6) + 0.0 AS "identity", CASE WHEN a > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "binary",
       round(greatest(a, 0), 6) + 0.0 AS relu, round(1 / (1 + exp(-a)), 6) + 0.0 AS sigmoid,
       round(ln(1 + exp(a)), 6) + 0.0 AS softplus, round(tanh(a), 6) + 0.0 AS tanh,
       round(exp(a) / (exp(a) + exp(b) + exp(c)), 6) + 0.0 AS softmax,
       round(sin(pi() * a) / (pi() * a), 6) + 0.0 AS sinc, round(ln(abs(a)) / ln(2), 6) + 0.0 AS log2
FROM x""")
def activations(spark, sf_dir):
    """Every activation and scalar function on the first channel."""
    rows = si.vectors(spark, sf_dir).withColumn(
        "feats", F.transform(F.slice("feats", 1, 3), lambda x: x * 10)
    )
    a = F.get("feats", F.lit(0))
    named = {name: fn(a) for name, fn in sl.ACTIVATIONS.items()}
    named["softmax"] = F.get(softmax(F.col("feats")), F.lit(0))
    named["sinc"], named["log2"] = sl.sinc(a), sl.log_base(F.abs(a), 2)
    return rows.select("utt", "frame_ix", *[r6(c).alias(n) for n, c in named.items()])


# --- mixtures: 3 components, 4 targets, 27 channels; targets are the next 4 --

K, D = 3, 4

_MIX = with_views("fx_vec") + """,
raw AS (SELECT utt, frame_ix, k, exp(feats[k + 1]) AS e, feats FROM fx_vec, (SELECT unnest([0, 1, 2]) AS k) kk),
mix AS (SELECT utt, frame_ix, k, e / sum(e) OVER (PARTITION BY utt, frame_ix) AS prior, feats FROM raw),
cell AS (SELECT utt, frame_ix, k, d, prior, feats[3 + k * 4 + d + 1] AS mean, exp(feats[15 + k * 4 + d + 1]) AS std,
                feats[27 + d + 1] AS target
         FROM mix, (SELECT unnest([0, 1, 2, 3]) AS d) dd)"""


def _density(x: str) -> str:
    return f"exp(-(({x}) - mean) * (({x}) - mean) / (2 * std * std)) / (sqrt(2 * pi()) * std)"


def _mixture(spark, sf_dir):
    frames = si.vectors(spark, sf_dir).withColumn("target", F.slice("feats", 28, D))
    return md.mixture_parameters(frames, K, D)


@query("mixture_params", _MIX + """
SELECT utt, frame_ix, CAST(k AS INT) AS k, CAST(d AS INT) AS d, round(prior, 6) + 0.0 AS prior, round(mean, 6) + 0.0 AS mean,
       round(std, 6) + 0.0 AS std FROM cell""")
def mixture_params(spark, sf_dir):
    cells = F.explode(F.sequence(F.lit(0), F.lit(K * D - 1))).alias("cell")
    rows = _mixture(spark, sf_dir).select("utt", "frame_ix", "priors", "means", "stds", cells)
    k = F.floor(F.col("cell") / D).cast("int")
    return rows.select(
        "utt", "frame_ix", k.alias("k"), (F.col("cell") % D).alias("d"),
        r6(F.get("priors", k)).alias("prior"), r6(F.get("means", F.col("cell"))).alias("mean"),
        r6(F.get("stds", F.col("cell"))).alias("std"),
    )


@query("mixture_loglik", _MIX + f""",
dens AS (SELECT utt, frame_ix, k, max(prior) * product({_density('target')}) AS w FROM cell GROUP BY utt, frame_ix, k),
lik AS (SELECT utt, frame_ix, sum(w) AS density FROM dens GROUP BY utt, frame_ix)
SELECT utt, round(avg(ln(density + 1e-62)), 6) + 0.0 AS log_likelihood, count(*) AS n FROM lik GROUP BY utt
UNION ALL SELECT NULL, round(avg(ln(density + 1e-62)), 6) + 0.0, count(*) FROM lik""")
def mixture_loglik(spark, sf_dir):
    """Mean log-likelihood per utterance and, with a NULL name, of the corpus."""
    rows = md.mixture_density(_mixture(spark, sf_dir), "target", K, D)
    per_utt = sc.mean_log_likelihood(rows, ["utt"])
    corpus = sc.mean_log_likelihood(rows).withColumn("utt", F.lit(None).cast("bigint"))
    return per_utt.unionByName(corpus).withColumn("log_likelihood", r6("log_likelihood"))


@query("mixture_predict", _MIX + f""",
guess AS (SELECT *, sum(prior * mean) OVER (PARTITION BY utt, frame_ix, d) AS g FROM cell),
dens AS (SELECT utt, frame_ix, k, product({_density('g')}) AS w FROM guess GROUP BY utt, frame_ix, k),
occ AS (SELECT utt, frame_ix, k, w / (sum(w) OVER (PARTITION BY utt, frame_ix) + 1e-30) AS o FROM dens),
pred AS (SELECT c.utt, c.frame_ix, d AS i, sum(o * mean) AS x FROM cell c
         JOIN occ USING (utt, frame_ix, k) GROUP BY c.utt, c.frame_ix, d)
""" + _pivoted("pred", ["y0", "y1", "y2", "y3"]))
def mixture_predict(spark, sf_dir):
    rows = md.mixture_prediction(_mixture(spark, sf_dir), K, D)
    return rows.select("utt", "frame_ix", *channels("y", D))


@query("dense_fit_step", with_views("fx_vec", "fx_vlong") + f""",
x0 AS (SELECT utt, frame_ix, channel AS i, value AS x FROM fx_vlong WHERE channel < 60),
o AS {_sql_layer('x0', 4, 1, '?')}
SELECT CAST(o.i AS INT) AS channel, round(sqrt(avg((o.x - t.value) * (o.x - t.value))), 6) + 0.0 AS loss
FROM o JOIN fx_vlong t ON t.utt = o.utt AND t.frame_ix = o.frame_ix AND t.channel = 60 + o.i GROUP BY o.i""")
def dense_fit_step(spark, sf_dir):
    """One Adam step over all vectors, the last four channels being targets;
    the loss before it, per channel."""
    rows = si.vectors(spark, sf_dir).select(
        F.slice("feats", 1, 60).alias("feats"), F.slice("feats", 61, 4).alias("target")
    )
    model = md.DenseModel([], layer(60, 4, 1, "identity"))
    _, _, per_channel = tr.fit_step(rows, model, tr.Adam())
    table = [(i, float(x)) for i, x in enumerate(per_channel)]
    return spark.createDataFrame(table, "channel int, loss double").withColumn("loss", r6("loss"))


@query("mlpg")
def mlpg(spark, sf_dir):
    """Trajectory of two static channels from a two-component mixture readout."""
    frames = si.vectors(spark, sf_dir).withColumn("feats", F.slice("feats", 1, 2 + 2 * 2 * 6))
    rows = tj.mixture_trajectory(md.mixture_parameters(frames, 2, 6), 2, 2)
    return rows.select("utt", "frame_ix", *channels("y", 6))

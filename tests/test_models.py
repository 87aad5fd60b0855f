import numpy as np
import pytest
from pyspark.sql import functions as F

from framelark.operators import models as md
from framelark.operators import scoring as sc
from framelark.operators import training as tr
from framelark.streaming.inversion import arriving_frames, invert_stream

RNG = np.random.default_rng(9)


def model(binary=True):
    return md.DenseModel(
        [md.Dense(RNG.normal(size=(3, 5)), RNG.normal(size=5), "tanh"),
         md.Dense(RNG.normal(size=(5, 4)), RNG.normal(size=4), "softplus")],
        md.Dense(RNG.normal(size=(4, 2)), RNG.normal(size=2), "identity"),
        md.Dense(RNG.normal(size=(4, 1)), RNG.normal(size=1), "sigmoid") if binary else None,
        (1,) if binary else (),
    )


def test_weights_round_trip(spark):
    m = model()
    back = md.model_from_table(md.weights_table(spark, m), (1,))
    x = RNG.normal(size=(6, 3))
    np.testing.assert_allclose(back.output(x), m.output(x))
    assert back.output(x).shape == (6, 3)
    assert set(back.output(x)[:, 1]) <= {0.0, 1.0}


def test_own_predict_function(make_frames, collect):
    x = RNG.normal(size=(9, 2))
    got = collect(md.map_vectors(make_frames({"u": x}), lambda v: v @ np.ones((2, 3)), 2))
    np.testing.assert_allclose(got["u"], x @ np.ones((2, 3)))
    with pytest.raises(Exception, match="width 5"):
        md.map_vectors(make_frames({"u": x}), lambda v: v, 5).collect()


def training_rows(spark, n=60):
    x, t = RNG.normal(size=(n, 3)), RNG.normal(size=(n, 3))
    t[:, 1] = t[:, 1] > 0
    rows = spark.createDataFrame(
        [([float(v) for v in a], [float(v) for v in b]) for a, b in zip(x, t)],
        "feats array<double>, target array<double>",
    ).repartition(3)
    return rows, x, t


def mean_loss(m, x, t):
    main, proba = m.predict(x)
    rmse = np.sqrt(((main - t[:, [0, 2]]) ** 2).mean(axis=0))
    p, y = proba[:, 0], t[:, 1]
    return np.mean([*rmse, -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()])


def test_gradient_by_finite_differences(spark):
    m = model()
    rows, x, t = training_rows(spark)
    per_channel, slope = tr.gradient(rows, m)
    assert per_channel.mean() == pytest.approx(mean_loss(m, x, t))
    values = tr.parameters(m)
    assert len(slope) == len(values)
    for i in range(0, len(values), 3):
        step = np.zeros_like(values)
        step[i] = 1e-6
        up, down = (mean_loss(tr.with_parameters(m, values + s), x, t) for s in (step, -step))
        assert slope[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_fitting_lowers_the_loss(spark):
    m, opt = model(), tr.Adam(rate=0.05)
    rows, x, t = training_rows(spark)
    before = mean_loss(m, x, t)
    for _ in range(5):
        m, opt, _ = tr.fit_step(rows, m, opt)
    assert opt.step == 5 and mean_loss(m, x, t) < before


def test_scores_equal_pooled_formula(make_frames):
    p, t = RNG.normal(size=(30, 2)), RNG.normal(size=(30, 2))
    cut = {"a": slice(0, 10), "b": slice(10, 30)}
    pred = make_frames({u: p[s] for u, s in cut.items()})
    true = make_frames({u: t[s] for u, s in cut.items()})
    scored = sc.paired(pred, true)
    got = {r["channel"]: r["score"] for r in sc.score_corpus(scored).collect()}
    by_utt = {(r["utt"], r["channel"]): r["rmse"] for r in sc.rmse_utterance(scored).collect()}
    for c in (0, 1):
        pooled = np.sqrt(((p - t)[:, c] ** 2).mean())
        weighted = np.sqrt((10 * by_utt["a", c] ** 2 + 20 * by_utt["b", c] ** 2) / 30)
        assert got[c] == pytest.approx(pooled) == pytest.approx(weighted)


def test_half_probability_rounds_to_zero(spark):
    rows = spark.createDataFrame([(0.5, 0.0), (0.5, 1.0), (1.0, 1.0), (0.0, 1.0)], "p double, t double")
    r = sc.binary_scores(rows).collect()[0]
    assert r["accuracy"] == 0.5 and np.isfinite(r["cross_entropy"])


def test_mixture_prediction_of_one_component_is_its_mean(make_frames, collect):
    x = RNG.normal(size=(5, 1 + 2 * 2))
    rows = md.mixture_parameters(make_frames({"u": x}), 1, 2)
    got = collect(md.mixture_prediction(rows, 1, 2))["u"]
    np.testing.assert_allclose(got, x[:, 1:3])


def test_mixture_density_with_shared_std_and_norms(make_frames):
    rows = make_frames({"u": np.array([[0.3, 0.7, 1.0, 2.0]])}).select(
        "utt", F.array(F.lit(0.25), F.lit(0.75)).alias("priors"), F.col("feats").alias("means"),
        F.array(F.lit(0.5), F.lit(2.0)).alias("stds"), F.array(F.lit(2.0), F.lit(3.0)).alias("x"),
    )
    got = md.mixture_density(rows, "x", 2, 2, norms=[2, 3], shared_std=True).collect()[0]["density"]

    def normal(x, m, s):
        return np.exp(-((x - m) ** 2) / (2 * s * s)) / (np.sqrt(2 * np.pi) * s)

    want = 0.25 * normal(1, 0.3, 0.5) * normal(1, 0.7, 0.5) + 0.75 * normal(1, 1, 2) * normal(1, 2, 2)
    assert got == pytest.approx(want)


def test_stream_equals_batch(spark, tmp_path, make_frames, collect):
    m = model()
    series = {"u": RNG.normal(size=(20, 3)), "v": RNG.normal(size=(8, 3))}
    source, out, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))

    def run():
        invert_stream(arriving_frames(spark, source), m, out, mark, [2, 0]).awaitTermination()

    make_frames({"u": series["u"]}).write.parquet(source)
    run()
    make_frames({"v": series["v"]}).write.mode("append").parquet(source)
    run()
    got = collect(spark.read.parquet(out))
    for utt, x in series.items():
        np.testing.assert_allclose(got[utt], m.output(x)[:, [2, 0]])

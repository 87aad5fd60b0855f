import inspect
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelark.operators import frames as fr
from framelark.operators import models as md
from framelark.operators import trajectory as tj
from framelark.plans import queries_models

SMALL = os.environ.get("FRAMELARK_SMALL", "/root/testdata/sf0.001")
RNG = np.random.default_rng(4)


def matrix_w(n):
    """Identity, slope and slope of slope by columns: the response to unit series."""
    def slope(x):
        t = np.arange(n)
        return sum(
            k * (x[np.minimum(t + k, n - 1)] - x[np.maximum(t - k, 0)]) for k in range(1, 6)
        ) / 110

    eye = np.eye(n)
    return np.vstack([eye, slope(eye), slope(slope(eye))])


def dense(means, stds, n_static):
    n = len(means)
    w = matrix_w(n)
    out = []
    for d in range(n_static):
        cols = [d, n_static + d, 2 * n_static + d]
        p = 1 / (stds[:, cols].T.ravel() ** 2 + 1e-30)
        c = np.linalg.solve((w.T * p) @ w, w.T @ (p * means[:, cols].T.ravel()))
        out.append((w @ c).reshape(3, n).T)
    return np.concatenate([np.stack([o[:, j] for o in out], axis=1) for j in range(3)], axis=1)


def table(spark, series):
    rows = [
        (u, t, [float(v) for v in m], [float(v) for v in s])
        for u, (mean, std) in series.items() for t, (m, s) in enumerate(zip(mean, std))
    ]
    return spark.createDataFrame(
        rows, "utt string, frame_ix int, means array<double>, stds array<double>"
    ).repartition(3)


def test_trajectory_equals_dense_solution(spark, collect):
    series = {}
    for u, n in (("long", 420), ("edge", 65), ("short", 12), ("even", 120)):
        series[u] = (RNG.normal(size=(n, 6)).cumsum(axis=0), np.exp(RNG.normal(size=(n, 6)) / 2))
    for segment, fan in ((60, 64), (60, 2), (512, 64)):
        got = collect(tj.trajectory(table(spark, series), 2, segment, fan))
        for u, (mean, std) in series.items():
            np.testing.assert_allclose(got[u], dense(mean, std, 2), atol=1e-8)


def test_segment_must_exceed_the_margins(spark):
    with pytest.raises(ValueError):
        tj.trajectory(table(spark, {}), 2, 20)


def log_density(x, m, s):
    return (-((x - m) ** 2) / (2 * s * s) - np.log(np.sqrt(2 * np.pi) * s)).sum(axis=-1)


def em(priors, means, stds, n_steps):
    def judge(path):
        dens = priors * np.exp(log_density(path[:, None], means, stds))
        return dens, np.log(dens.sum(axis=1) + 1e-30).sum()

    path = dense((priors[..., None] * means).sum(1), (priors[..., None] * stds).sum(1), 1)
    dens, score = judge(path)
    for _ in range(n_steps):
        occ = (dens / (dens.sum(axis=1, keepdims=True) + 1e-30))[..., None]
        new = dense((occ * means).sum(1), (occ * stds).sum(1), 1)
        new_dens, new_score = judge(new)
        if not new_score > score:
            break
        path, dens, score = new, new_dens, new_score
    return path


def test_mixture_trajectory_equals_plain_loop(spark, make_frames, collect):
    series = {"a": RNG.normal(size=(30, 14)), "b": RNG.normal(size=(9, 14)) * 0.5}
    mixture = md.mixture_parameters(make_frames(series), 2, 3)
    for steps in (1, 4):
        got = collect(tj.mixture_trajectory(mixture, 2, 1, n_steps=steps))
        for u, x in series.items():
            e = np.exp(x[:, :2])
            want = em(e / e.sum(1, keepdims=True), x[:, 2:8].reshape(-1, 2, 3),
                      np.exp(x[:, 8:]).reshape(-1, 2, 3), steps)
            np.testing.assert_allclose(got[u], want, atol=1e-8)


def test_dynamic_blocks_follow_the_static_one(spark, collect):
    mean, std = RNG.normal(size=(40, 3)), np.ones((40, 3))
    path = tj.trajectory(table(spark, {"u": (mean, std)}), 1)
    static = path.withColumn("feats", F.slice("feats", 1, 1))
    np.testing.assert_allclose(
        collect(path)["u"], collect(fr.dynamic_features(static, 1))["u"], atol=1e-12
    )


def test_mlpg_query_runs_the_default_steps(spark, monkeypatch):
    default = inspect.signature(tj.mixture_trajectory)
    used = []

    def noted(*args, **options):
        call = default.bind(*args, **options)
        call.apply_defaults()
        used.append(call.arguments["n_steps"])
        return args[0].select("utt", "frame_ix", F.array_repeat(F.lit(0.0), 6).alias("feats"))

    monkeypatch.setattr(tj, "mixture_trajectory", noted)
    queries_models.mlpg(spark, SMALL)
    assert used == [default.parameters["n_steps"].default]

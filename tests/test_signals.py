import numpy as np
import pytest
from pyspark.sql import functions as F

from framelark.functions import kernels
from framelark.operators import signals as sg
from framelark.operators import spectra

RNG = np.random.default_rng(7)


def difference_equation(b, a, x, z):
    """Direct form II transposed, one channel."""
    z, y = list(z), []
    for v in x:
        out = b[0] * v + z[0]
        for i in range(len(z)):
            z[i] = b[i + 1] * v + (z[i + 1] if i + 1 < len(z) else 0) - a[i + 1] * out
        y.append(out)
    return np.array(y)


def forward_backward(x, order, cutoff, rate):
    zeros, poles, gain = kernels.butterworth(order, cutoff, rate)
    b, a = gain * np.real(np.poly(zeros)), np.real(np.poly(poles))
    # State after an endless run of ones.
    z1 = np.zeros(order)
    for i in range(order - 1, -1, -1):
        z1[i] = b[i + 1] - a[i + 1] + (z1[i + 1] if i + 1 < order else 0)
    pad = 3 * (order + 1)
    ext = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2:-pad - 2:-1]]
    y = difference_equation(b, a, ext, z1 * ext[0])
    y = difference_equation(b, a, y[::-1], z1 * y[-1])[::-1]
    return y[pad:-pad]


@pytest.mark.parametrize("segment", [None, 97])
def test_zero_phase_filter(make_frames, collect, segment):
    series = {"u": RNG.normal(size=(400, 2)).cumsum(axis=0), "v": RNG.normal(size=(30, 2))}
    got = collect(sg.lowpass_filter(make_frames(series), 20, 200, 2, segment=segment))
    for utt, x in series.items():
        want = np.stack([forward_backward(c, 5, 20, 200) for c in x.T], axis=1)
        np.testing.assert_allclose(got[utt], want, atol=1e-9)


def test_filter_passes_low_and_stops_high(make_frames, collect):
    t = np.arange(400) / 200
    low, high = np.sin(2 * np.pi * 5 * t), np.sin(2 * np.pi * 60 * t)
    got = collect(sg.lowpass_filter(make_frames({"u": (low + high)[:, None]}), 20, 200, 1))["u"]
    np.testing.assert_allclose(got[50:-50, 0], low[50:-50], atol=5e-3)


def test_butterworth_gain():
    zeros, poles, gain = kernels.butterworth(5, 20, 200)

    def response(f):
        z = np.exp(2j * np.pi * f / 200)
        return abs(gain * np.prod(z - zeros) / np.prod(z - poles))

    assert response(0) == pytest.approx(1)
    assert response(20) == pytest.approx(np.sqrt(0.5))


def full_spline(x, y, at):
    """Cubic B-spline-free check: solve for all polynomials at once, densely."""
    n = len(x)
    rows, rhs = [], []

    def basis(i, t, d):
        row = np.zeros(4 * (n - 1))
        s = t - x[i]
        powers = {0: [1, s, s**2, s**3], 1: [0, 1, 2 * s, 3 * s**2], 2: [0, 0, 2, 6 * s],
                  3: [0, 0, 0, 6]}[d]
        row[4 * i:4 * i + 4] = powers
        return row

    for i in range(n - 1):
        rows += [basis(i, x[i], 0), basis(i, x[i + 1], 0)]
        rhs += [y[i], y[i + 1]]
    for i in range(1, n - 1):
        for d in (1, 2):
            rows.append(basis(i - 1, x[i], d) - basis(i, x[i], d))
            rhs.append(0)
    rows += [basis(0, x[1], 3) - basis(1, x[1], 3), basis(n - 3, x[n - 2], 3) - basis(n - 2, x[n - 2], 3)]
    rhs += [0, 0]
    coef = np.linalg.solve(np.array(rows), np.array(rhs)).reshape(-1, 4)
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    s = at - x[i]
    return (coef[i] * np.stack([s**0, s, s**2, s**3], axis=1)).sum(axis=1)


@pytest.mark.parametrize("segment", [None, 29])
def test_spline_fill(make_frames, collect, segment):
    x = RNG.normal(size=(260, 3))
    x[:, 0][RNG.random(260) < 0.3] = np.nan
    x[:3, 0], x[-2:, 0], x[100:130, 0] = np.nan, np.nan, np.nan
    x[5, 1] = np.nan
    got = collect(sg.fill_gaps(make_frames({"u": x, "v": np.ones((5, 3))}), 3, segment=segment))
    for c in (0, 1):
        ok = np.flatnonzero(~np.isnan(x[:, c]))
        want = full_spline(ok.astype(float), x[ok, c], np.arange(260.0))
        np.testing.assert_allclose(got["u"][:, c], want, rtol=1e-7, atol=1e-7)
    np.testing.assert_array_equal(got["u"][:, 2], x[:, 2])
    np.testing.assert_array_equal(got["v"], 1)


def test_spline_needs_four_values(make_frames):
    x = np.array([[1.0], [np.nan], [2.0], [3.0]])
    with pytest.raises(Exception, match="4 finite values"):
        sg.fill_gaps(make_frames({"u": x}), 1).collect()


@pytest.mark.parametrize("n, ratio", [(101, 0.5), (100, 0.5), (40, 1.7), (30, 2.0)])
def test_long_resampling_equals_whole(make_frames, collect, n, ratio):
    x = RNG.normal(size=(n, 2))
    want = kernels.fft_resample(x, int(n * ratio))
    frames = make_frames({"u": x, "v": x[:5]})
    got = collect(sg.resample(frames, 100, 100 * ratio, 2, whole_limit=10))
    np.testing.assert_allclose(got["u"], want, atol=1e-12)
    np.testing.assert_allclose(got["v"], kernels.fft_resample(x[:5], int(5 * ratio)), atol=1e-12)


def test_long_series_of_many_lengths_share_a_plan(make_frames, collect):
    series = {f"u{n}": RNG.normal(size=(n, 1)) for n in (11, 31, 40, 41, 64, 65)}
    out = sg.resample(make_frames(series), 100, 60, 1, whole_limit=10)
    got = collect(out)
    for utt, x in series.items():
        np.testing.assert_allclose(got[utt], kernels.fft_resample(x, int(len(x) * 0.6)), atol=1e-12)

    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange")

    two = sg.resample(make_frames({u: series[u] for u in ("u40", "u41")}), 100, 60, 1, whole_limit=10)
    assert exchanges(out) == exchanges(two)


def test_the_chirp_of_long_series_is_not_broadcast(make_frames, spark):
    x = RNG.normal(size=(700, 1))
    rows = make_frames({"u": x}).select(
        "utt", F.lit(700).cast("long").alias("n"), F.col("frame_ix").alias("ix"),
        F.get("feats", F.lit(0)).alias("re"), F.lit(0.0).alias("im"))
    out = spectra.dft(rows, ["utt", "n"], "n", rows.select(F.col("n").alias("size")).distinct())
    got = {r["ix"]: complex(r["re"], r["im"]) for r in out.collect()}
    np.testing.assert_allclose([got[i] for i in range(700)], np.fft.fft(x[:, 0]), atol=1e-9)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    lags = spectra._stretched(spark.range(1, 2).select((F.col("id") * 300_000).alias("size")))
    assert lags.rdd.getNumPartitions() == 4  # not one for its few starting points
    assert lags.count() == 599_999


def test_resampling_a_periodic_sine_is_exact(make_frames, collect):
    t = np.arange(500) / 500
    got = collect(sg.resample(make_frames({"u": np.sin(2 * np.pi * 7 * t)[:, None]}), 500, 100, 1))
    np.testing.assert_allclose(got["u"][:, 0], np.sin(2 * np.pi * 7 * np.arange(100) / 100), atol=1e-12)
    frames = make_frames({"u": t[:, None]})
    assert sg.resample(frames, 100, 100, 1).columns == ["utt", "frame_ix", "feats"]


def test_prediction_recovers_an_ar_process():
    e = RNG.normal(size=20_000)
    x = np.zeros_like(e)
    for i in range(2, len(x)):
        x[i] = 1.3 * x[i - 1] - 0.6 * x[i - 2] + e[i]
    a, error = kernels.linear_prediction(x[None, :], 2)
    np.testing.assert_allclose(a[0], [1.3, -0.6], atol=0.02)
    assert error[0] == pytest.approx(1, abs=0.02)


def test_prediction_solves_the_normal_equations():
    frames = RNG.normal(size=(4, 64))
    a, _ = kernels.linear_prediction(frames, 12)
    for f, coef in zip(frames, a):
        r = np.array([f[: 64 - k] @ f[k:] for k in range(13)])
        toeplitz = r[np.abs(np.subtract.outer(np.arange(12), np.arange(12)))]
        np.testing.assert_allclose(toeplitz @ coef, r[1:], atol=1e-9)
    assert np.isnan(kernels.linear_prediction(np.zeros((1, 16)), 3)[0]).all()


@pytest.mark.parametrize("order", [8, 13, 20])
def test_line_spectrum_round_trip(order):
    a, _ = kernels.linear_prediction(RNG.normal(size=(6, 200)), order)
    poly = np.concatenate([np.ones((6, 1)), -a], axis=1)
    lines = kernels.line_spectrum(poly)
    assert lines.shape == (6, order)
    assert (np.diff(lines, axis=1) >= 0).all() and (lines > 0).all() and (lines < np.pi).all()
    np.testing.assert_allclose(kernels.prediction_from_lines(lines), poly, atol=1e-6)


def test_mel_bank_and_cosine_basis():
    bank = kernels.mel_bank(16000, 400, 40)
    assert bank.shape == (40, 201) and (bank >= 0).all() and (bank.sum(axis=1) > 0).all()
    basis = kernels.cosine_basis(13, 40)
    np.testing.assert_allclose(basis @ basis.T, np.eye(13), atol=1e-12)


@pytest.mark.parametrize("block", [16, 32, 50, 1000])
def test_framing_by_blocks(spark, block):
    x = RNG.normal(size=333)
    rows = spark.createDataFrame(
        [("u", i, float(v)) for i, v in enumerate(x)], "utt string, sample_ix int, value double"
    )
    audio = sg.blocks(rows, block=block)
    for centred in (False, True):
        got = sg.framed(audio, 16, 5, centred, block).orderBy("frame_ix").collect()
        y = np.pad(x, 8, mode="reflect") if centred else x
        n = 1 + (len(y) - 16) // 5
        assert [r["frame_ix"] for r in got] == list(range(n))
        want = np.stack([y[5 * i:5 * i + 16] for i in range(n)])
        np.testing.assert_array_equal(np.array([r["feats"] for r in got]), want)


def test_audio_feature_widths(spark):
    x = RNG.normal(size=3000)
    rows = spark.createDataFrame(
        [("u", i, float(v)) for i, v in enumerate(x)], "utt string, sample_ix int, value double"
    )
    audio = sg.blocks(rows)
    for form in ("mfcc", "lpc", "lsf"):
        got = sg.audio_features(audio, form, 16000, 10).select(F.size("feats").alias("n"))
        assert {r["n"] for r in got.collect()} == {sg.audio_width(form, 10)}
    with pytest.raises(ValueError):
        sg.audio_features(audio, "energy", 16000)

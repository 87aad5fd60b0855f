import numpy as np
import pytest
from pyspark.sql import functions as F

from framelark.functions.vectors import interlaced
from framelark.operators import channels as ch
from framelark.operators import frames as fr
from framelark.operators import moments as mo

RNG = np.random.default_rng(5)
SERIES = {"hot": RNG.normal(size=(150, 2)), "a": RNG.normal(size=(7, 2)), "b": RNG.normal(size=(1, 2))}


def delta(x, window=5):
    n = len(x)
    out = np.zeros_like(x)
    for k in range(1, window + 1):
        ahead = x[np.minimum(np.arange(n) + k, n - 1)]
        back = x[np.maximum(np.arange(n) - k, 0)]
        out += k * (ahead - back)
    return out / (2 * sum(k * k for k in range(1, window + 1)))


@pytest.mark.parametrize("segment", [None, 13, 40])
def test_dynamics_do_not_depend_on_segments(make_frames, collect, segment):
    got = collect(fr.dynamic_features(make_frames(SERIES), 2, segment=segment))
    for utt, x in SERIES.items():
        d = delta(x)
        np.testing.assert_allclose(got[utt], np.hstack([x, d, delta(d)]), atol=1e-12)


@pytest.mark.parametrize("segment", [None, 4, 11])
def test_difference_context_and_filter_by_segments(make_frames, collect, segment):
    frames = make_frames(SERIES)
    diff = collect(fr.simple_difference(frames, 4, 2, segment=segment))
    ctx = collect(fr.context_windows(frames, 2, 3, segment=segment))
    edge = collect(fr.context_windows(frames, 2, 3, zero_padding=False, segment=segment))
    low = collect(fr.lowpass_fir(frames, [20, 50], 2, segment=segment))
    taps = np.array([fr.fir_taps(c, 200, 5) for c in (20, 50)])
    for utt, x in SERIES.items():
        n = len(x)
        at = np.arange(n)
        np.testing.assert_allclose(
            diff[utt], x[np.minimum(at + 4, n - 1)] - x[np.maximum(at - 4, 0)]
        )
        pad = np.vstack([np.zeros((3, 2)), x, np.zeros((3, 2))])
        want = np.hstack([pad[i:i + n] for i in range(7)])
        np.testing.assert_allclose(ctx[utt], want)
        if n > 6:
            np.testing.assert_allclose(edge[utt], want[3:-3])
        else:
            assert utt not in edge
        pad = np.vstack([np.zeros((5, 2)), x, np.zeros((5, 2))])
        want = sum(pad[i:i + n] * taps[:, i] for i in range(11))
        np.testing.assert_allclose(low[utt], want, atol=1e-14)


def test_same_result_under_any_partitioning(spark, make_frames, collect):
    results = []
    for n in (1, 4, 64):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(collect(fr.dynamic_features(make_frames(SERIES, n), 2)))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    for other in results[1:]:
        for utt in SERIES:
            np.testing.assert_array_equal(results[0][utt], other[utt])


def test_delta_of_constant_and_line(make_frames, collect):
    t = np.arange(30.0)
    x = np.stack([np.full(30, 3.0), 2 * t], axis=1)
    got = collect(fr.delta(make_frames({"u": x}), 2))["u"]
    np.testing.assert_allclose(got[:, 0], 0)
    np.testing.assert_allclose(got[5:-5, 1], 2)


def test_delta_matrix_times_series_is_delta(spark, make_frames, collect):
    frames = make_frames(SERIES)
    cells = fr.delta_matrix(fr.lengths(frames)).collect()
    want = collect(fr.delta(frames, 2))
    got = {u: np.zeros_like(x) for u, x in SERIES.items()}
    for r in cells:
        got[r["utt"]][r["t"]] += r["w"] * SERIES[r["utt"]][r["s"]]
    for utt in SERIES:
        np.testing.assert_allclose(got[utt], want[utt], atol=1e-12)


def test_number_rows_with_and_without_bucket(spark):
    rows = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"),
        F.xxhash64("id").alias("o"),
    )
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r["o"]):
        want.setdefault(r["k"], []).append(r["o"])
    for bucket in (F.floor(F.col("o") / 10**17), None):
        got = fr.number_rows(rows, ["k"], ["o"], bucket, "ix").collect()
        assert len(got) == 500
        assert all(want[r["k"]][r["ix"]] == r["o"] for r in got)


def test_batches_round_trip(make_frames, collect):
    frames = make_frames(SERIES)
    batch = fr.padded_batch(frames, 2)
    assert batch.count() == 150 * 3
    back = collect(fr.unpadded(batch))
    cut = collect(fr.unpadded(fr.padded_batch(frames, 2, length=20)))
    packed = collect(fr.unpacked_batch(fr.packed_batch(frames, 2, 20)))
    for utt, x in SERIES.items():
        np.testing.assert_array_equal(back[utt], x)
        np.testing.assert_array_equal(cut[utt], x[:20])
        np.testing.assert_array_equal(packed[utt], x[:20])


def test_normalised_data_has_mean_0_and_std_1(make_frames, collect):
    frames = make_frames(SERIES).withColumn("speaker", F.lit("s"))
    for scope in ("corpus", "speaker"):
        rows = mo.normalize(frames, "stds", scope, 2)
        x = np.vstack(list(collect(rows).values()))
        np.testing.assert_allclose(x.mean(axis=0), 0, atol=1e-12)
        np.testing.assert_allclose(x.std(axis=0), 1, atol=1e-12)


def test_zero_divisor_gives_null(make_frames):
    frames = make_frames({"u": np.ones((4, 1))}).withColumn("speaker", F.lit("s"))
    rows = mo.normalize(frames, "spread", "file", 1).collect()
    assert [r["feats"] for r in rows] == [[None]] * 4


def test_moments_of_stored_files_roll_up(make_frames):
    frames = make_frames(SERIES).withColumn("speaker", F.substring("utt", 1, 1))
    whole = np.vstack(list(SERIES.values()))
    rows = [r for r in mo.all_scopes(frames).collect() if r["scope"] == "corpus"]
    for r in rows:
        c = r["channel"]
        assert r["n"] == len(whole)
        np.testing.assert_allclose(r["mean"], whole[:, c].mean())
        np.testing.assert_allclose(r["std"], whole[:, c].std())
        np.testing.assert_allclose(r["spread"], np.ptp(whole[:, c]))


def test_argument_errors(make_frames):
    frames = make_frames(SERIES).withColumn("speaker", F.lit("s"))
    with pytest.raises(ValueError):
        mo.normalize(frames, "stds", "town", 2)
    with pytest.raises(KeyError):
        mo.normalize(frames, "mean", "corpus", 2)
    with pytest.raises(KeyError, match="unknown channels"):
        ch.select_channels(frames, ["x", "y"], ["z"])
    with pytest.raises(ValueError):
        fr.lowpass_fir(frames, [1, 2, 3], 2)
    with pytest.raises(ValueError):
        interlaced(F.col("a"), 2, F.col("b"), [3, 1])


def test_unequal_lengths_fail(make_frames):
    left = make_frames({"u": np.ones((4, 1))})
    right = make_frames({"u": np.ones((5, 1))})
    with pytest.raises(Exception, match="unequal length"):
        ch.concat_features(left, right).collect()
    with pytest.raises(Exception, match="expected 2 channels"):
        ch.checked_width(left, 2).collect()


def test_channel_selection_order(make_frames, collect):
    frames = make_frames({"u": np.array([[1.0, 2.0, 3.0]])})
    got = collect(ch.select_channels(frames, ["a ", "b", "c"], ["c", "a"]))
    np.testing.assert_array_equal(got["u"], [[3.0, 1.0]])
    assert ch.keep_channels(frames, []) is frames

"""What must not be lost silently: channels, recordings, labels, NULL speakers."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_abx import brute, make, table
from test_sources import est_bytes, put, wav_bytes

from framelark.operators import abx
from framelark.operators import frames as fr
from framelark.operators import moments as mo
from framelark.plans import corpora, extraction
from framelark.sources import binary, store, text

RNG = np.random.default_rng(9)


@pytest.mark.parametrize("width", [2, 4])
def test_wrong_width_fails(make_frames, width):
    frames = make_frames({"u": RNG.normal(size=(6, 3))})
    with pytest.raises(Exception, match="another width"):
        fr.delta(frames, width=width).collect()


def test_stored_kind_keeps_its_channels(spark, tmp_path, make_frames, collect):
    x = RNG.normal(size=(40, 3))
    store.write_features(make_frames({"s_1": x}), str(tmp_path), "c", "mfcc")
    name = extraction.normalize_kind(spark, str(tmp_path), "c", "mfcc", "stds")
    got = collect(store.read_features(spark, str(tmp_path), "c", f"mfcc_{name}"))["s_1"]
    np.testing.assert_allclose(got, (x - x.mean(0)) / x.std(0))


def test_unknown_rate_fails(spark, tmp_path):
    for name, rate in (("a", 8000), ("b", 4000)):
        put(f"{tmp_path}/{name}.wav", wav_bytes(np.zeros(800), rate))
    audio = binary.read_audio(spark, str(tmp_path))
    with pytest.raises(Exception, match="not among"):
        binary.audio_at_rate(audio, [8000], 8000).collect()
    assert binary.audio_at_rate(audio, [8000, 4000], 8000).select("utt").distinct().count() == 2


def test_corpus_audio_comes_at_its_rate(spark, tmp_path):
    put(f"{tmp_path}/wav_16kHz/m_1.wav", wav_bytes(np.zeros(800), 8000))
    adapter = corpora.Mngu0(str(tmp_path), source_rates=(16000, 8000))
    rows = adapter.audio(spark).collect()
    assert [(r["sr"], len(r["samples"])) for r in rows] == [(16000, 1600)]
    with pytest.raises(Exception, match="not among"):
        corpora.Mngu0(str(tmp_path)).audio(spark).collect()


def test_labels_without_header_fail(spark, tmp_path):
    put(f"{tmp_path}/m_1.lab", "#\n\t 0.1 26 \ta\n")
    put(f"{tmp_path}/m_2.lab", "\t 0.1 26 \ta\n")
    with pytest.raises(Exception, match="no line #"):
        text.read_mngu0_labels(spark, f"{tmp_path}/*.lab").collect()


def test_null_speakers_keep_their_frames(make_frames, collect):
    x, y = RNG.normal(size=(6, 2)), RNG.normal(size=(6, 2))
    frames = make_frames({"a": x, "b": y}).withColumn(
        "speaker", F.when(F.col("utt") == "a", F.lit("s")))
    for scope, want in (("file", y), ("speaker", y)):
        got = collect(mo.normalize(frames, "stds", scope, 2))
        np.testing.assert_allclose(got["b"], (want - want.mean(0)) / want.std(0))
        assert got.keys() == {"a", "b"}
    rows = mo.all_scopes(frames).where("scope = 'speaker'").collect()
    assert sorted((r["speaker"] or "", r["channel"]) for r in rows) == [
        ("", 0), ("", 1), ("s", 0), ("s", 1)]


def test_channels_are_chosen_by_each_files_names(spark, tmp_path, collect):
    a, b = RNG.normal(size=(5, 2)).astype("f4"), RNG.normal(size=(5, 2)).astype("f4")
    put(f"{tmp_path}/ema_basic_data/m_1.ema", est_bytes(a, ["ul_x", "ll_x"]))
    put(f"{tmp_path}/ema_basic_data/m_2.ema", est_bytes(b, ["ll_x", "ul_x"]))
    got = collect(corpora.Mngu0(str(tmp_path)).ema(spark, ["ul_x"]))
    np.testing.assert_allclose(got["m_1"], a[:, :1], rtol=1e-6)
    np.testing.assert_allclose(got["m_2"], b[:, 1:], rtol=1e-6)
    whole = collect(corpora.Mngu0(str(tmp_path)).ema(spark))
    np.testing.assert_allclose(whole["m_2"], b[:, ::-1], rtol=1e-6)
    with pytest.raises(Exception, match="no channel tt_x"):
        corpora.Mngu0(str(tmp_path)).ema(spark, ["tt_x"]).collect()


@pytest.mark.parametrize("tile", [512, 6])
@pytest.mark.parametrize("lengths", [1, 4])
def test_zero_frames_are_at_distance_one(spark, monkeypatch, tile, lengths):
    monkeypatch.setattr("test_abx.cosine", lambda a, b: 1 - a @ b / (
        np.sqrt((a @ a) * (b @ b)) or 1.0))
    monkeypatch.setattr(abx, "CELLS_AT_ONCE", 40)
    tokens = make(26, lengths, 3)
    for i in (2, 5, 9):
        tokens[i][3][0] = 0
    rows = abx.abx_scores(table(spark, tokens), 3, by=["context"], tile=tile).collect()
    got = {(r["phone_1"], r["phone_2"], r["context"]): (r["score"], r["n"]) for r in rows}
    want = brute(tokens)
    assert got.keys() == want.keys()
    for key, (score, n) in want.items():
        assert got[key] == (pytest.approx(score, abs=1e-12), n)


def test_other_values_fail(spark):
    tokens = make(8, 1, 1)
    tokens[0][3][0, 0] = np.nan
    with pytest.raises(Exception, match="not finite"):
        abx.abx_scores(table(spark, tokens), 3, by=["context"]).collect()

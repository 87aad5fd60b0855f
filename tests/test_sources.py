import io
import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelark.operators import moments as mo
from framelark.operators import phones as ph
from framelark.operators import signals as sg
from framelark.plans import corpora, extraction
from framelark.plans.loading import LoadingSetup, abx_features, load_dataset, parse_norm
from framelark.sources import binary, store, text

RNG = np.random.default_rng(1)


def put(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as file:
        file.write(content if isinstance(content, bytes) else content.encode())


def wav_bytes(x, rate, width=2, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(channels)
        file.setsampwidth(width)
        file.setframerate(rate)
        file.writeframes((x * 32767).astype("<i2").tobytes())
    return out.getvalue()


def sphere_bytes(x, rate, order="01"):
    head = (
        f"NIST_1A\n   1024\nsample_count -i {len(x)}\nsample_rate -i {rate}\nchannel_count -i 1\n"
        f"sample_n_bytes -i 2\nsample_byte_format -s2 {order}\nsample_coding -s3 pcm\nend_head\n"
    )
    kind = "<i2" if order == "01" else ">i2"
    return head.encode().ljust(1024) + (x * 32767).astype(kind).tobytes()



def est_bytes(data, names, kind="binary", order="01"):
    head = ["EST_File Track", f"DataType {kind}", f"ByteOrder {order}", f"NumFrames {len(data)}",
            f"NumChannels {len(names)}"]
    head += [f"Channel_{i} {n}" for i, n in enumerate(names)] + ["EST_Header_End\n"]
    n = len(data)
    full = np.column_stack([np.arange(n) / 500, np.ones(n), data])
    if kind == "ascii":
        body = "\n".join(" ".join(repr(float(v)) for v in row) for row in full).encode()
    else:
        body = full.astype("<f4" if order == "01" else ">f4").tobytes()
    return "\n".join(head).encode() + body


def test_wav_and_sphere(spark, tmp_path):
    x = np.sin(2 * np.pi * 440 * np.arange(16000) / 16000) * 0.5
    put(f"{tmp_path}/w/s_1.wav", wav_bytes(x, 16000))
    put(f"{tmp_path}/w/s_2.wav", wav_bytes(np.repeat(x, 2), 16000, channels=2))
    rows = binary.read_audio(spark, f"{tmp_path}/w", block=5000).orderBy("utt", "block_ix").collect()
    assert [(r["utt"], r["block_ix"], r["sr"]) for r in rows] == [
        (u, b, 16000) for u in ("s_1", "s_2") for b in range(4)
    ]
    for utt in ("s_1", "s_2"):
        got = np.concatenate([r["samples"] for r in rows if r["utt"] == utt])
        np.testing.assert_allclose(got, x, atol=1e-4)
    for order in ("01", "10"):
        rate, got = binary.decode_sphere(sphere_bytes(x, 16000, order))
        assert rate == 16000
        np.testing.assert_allclose(got, x, atol=1e-4)
    with pytest.raises(ValueError):
        binary.decode_sphere(b"RIFF" + b"\n" * 2000)


def test_audio_at_one_rate(spark, tmp_path):
    t = np.arange(4000) / 8000
    put(f"{tmp_path}/a.wav", wav_bytes(np.sin(2 * np.pi * 100 * t) / 2, 8000))
    put(f"{tmp_path}/b.wav", wav_bytes(np.sin(2 * np.pi * 100 * np.arange(2000) / 4000) / 2, 4000))
    audio = binary.audio_at_rate(binary.read_audio(spark, str(tmp_path)), [8000, 4000], 4000)
    got = {r["utt"]: r for r in audio.collect()}
    assert {len(r["samples"]) for r in got.values()} == {2000}
    np.testing.assert_allclose(got["a"]["samples"], got["b"]["samples"], atol=1e-4)


@pytest.mark.parametrize("kind, order", [("binary", "01"), ("binary", "10"), ("ascii", "01")])
def test_est(spark, tmp_path, kind, order):
    data = RNG.normal(size=(20, 3)).astype("f4").astype(float)
    put(f"{tmp_path}/u1.ema", est_bytes(data, ["tt_x", "tt_y", "v_x "], kind, order))
    rows = binary.read_est(spark, str(tmp_path)).orderBy("frame_ix").collect()
    np.testing.assert_allclose([r["feats"] for r in rows], data, rtol=1e-6)
    np.testing.assert_allclose([r["time"] for r in rows], np.arange(20) / 500, rtol=1e-6)
    names = binary.est_channels(spark, str(tmp_path)).orderBy("channel").collect()
    assert [r["name"] for r in names] == ["tt_x", "tt_y", "v_x"]


def test_bad_est(spark, tmp_path):
    put(f"{tmp_path}/u.ema", est_bytes(np.ones((5, 2)), ["a", "b"])[:-4])
    with pytest.raises(Exception, match="expected 5 rows"):
        binary.read_est(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="not an EST"):
        binary.decode_est(b"something else")


def test_label_dialects(spark, tmp_path):
    put(f"{tmp_path}/a/s_1.lab", "0 0.1 sil\n0.1 0.2 breath\n0.2 0.3 sil\n0.3 0.45 ae\n0.45 0.5 breath\n")
    got = [tuple(r) for r in text.read_mocha_labels(spark, f"{tmp_path}/a/*.lab").orderBy("phone_ix").collect()]
    assert got == [("s_1", 0, 0.3, "#"), ("s_1", 1, 0.45, "ae"), ("s_1", 2, 0.5, "#")]
    put(f"{tmp_path}/b/m_1.lab", "signal x\nnfields 1\n#\n\t 0.12499 26 \t#\n\t 0.135 26 \ta\n\t 0.145 26 \tb\n")
    got = [tuple(r) for r in text.read_mngu0_labels(spark, f"{tmp_path}/b/*.lab").orderBy("phone_ix").collect()]
    assert got == [("m_1", 0, 0.12, "#"), ("m_1", 1, round(0.135, 2), "a"), ("m_1", 2, round(0.145, 2), "b")]
    put(f"{tmp_path}/c/cnz_1.lab", "0 0.2 sil\n0.2 0.3 k word\n0.3 0.4 a\n0.4 0.6 sil\n")
    got = [tuple(r) for r in text.read_mspka_labels(spark, f"{tmp_path}/c/*.lab").orderBy("phone_ix").collect()]
    assert got == [("cnz_1", 0, 0.2, "#"), ("cnz_1", 1, 0.3, "k"), ("cnz_1", 2, 0.4, "a"), ("cnz_1", 3, 0.6, "#")]


def test_transcripts(spark, tmp_path):
    put(f"{tmp_path}/cnz_1.lab", "0 0.2 sil\n0.2 0.3 k cat\n0.3 0.4 a\n0.4 0.5 t\n0.5 0.6 sil\n0.6 0.7 i is\n0.7 0.8 z\n")
    lines = text.read_lines(spark, f"{tmp_path}/*.lab")
    words = ph.transcript_words(lines)
    assert [r["transcript"] for r in ph.transcript_text(words).collect()] == ["cat is"]
    phones = ph.transcript_text(ph.phonetic_words(lines, silences=["sil"]))
    assert [r["transcript"] for r in phones.collect()] == ["k-a-t i-z"]


def test_channel_lines(spark, tmp_path):
    data = RNG.integers(0, 99, size=(3, 7)).astype(float)
    put(f"{tmp_path}/x_1.ema", "\n".join(" ".join(str(v) for v in row) for row in data))
    rows = text.read_channel_lines(spark, f"{tmp_path}/*.ema").orderBy("frame_ix").collect()
    np.testing.assert_array_equal([r["feats"] for r in rows], data.T)


def test_ark_round_trip(spark, tmp_path, make_frames, collect):
    series = {"u1": RNG.normal(size=(40, 2)), "u2": RNG.normal(size=(1, 2)), "u3": RNG.normal(size=(9, 2))}
    spark.conf.set("spark.sql.shuffle.partitions", 5)
    text.write_ark(make_frames(series), f"{tmp_path}/ark")
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    got = collect(text.read_ark(spark, f"{tmp_path}/ark"))
    assert got.keys() == series.keys()
    for utt, x in series.items():
        np.testing.assert_array_equal(got[utt], x)
    with pytest.raises(Exception, match="(?i)exists"):
        text.write_ark(make_frames(series), f"{tmp_path}/ark")


def test_ark_text_and_small_splits(spark, tmp_path, collect):
    body = "".join(
        f"utt{u} [\n" + "\n".join(f"{u} {i}" for i in range(50)) + " ]\n" for u in range(6)
    )
    put(f"{tmp_path}/x.txt", body)
    assert body.startswith("utt0 [\n0 0\n0 1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 256)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = collect(text.read_ark(spark, f"{tmp_path}/x.txt"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got) == [f"utt{u}" for u in range(6)]
    for u in range(6):
        np.testing.assert_array_equal(got[f"utt{u}"], [[u, i] for i in range(50)])


def test_npy(spark, tmp_path, collect):
    x = RNG.normal(size=(12, 3))
    out = io.BytesIO()
    np.save(out, x)
    put(f"{tmp_path}/s_1_mfcc.npy", out.getvalue())
    got = collect(binary.read_npy(spark, str(tmp_path), "mfcc"))
    np.testing.assert_array_equal(got["s_1"], x)


def test_lists_items_scores(spark, tmp_path):
    sets = spark.createDataFrame([("u1", "train"), ("u2", "test")], "utt string, set_name string")
    text.write_filesets(sets, f"{tmp_path}/sets")
    assert {tuple(r) for r in text.read_filesets(spark, f"{tmp_path}/sets").collect()} == {
        ("u1", "train"), ("u2", "test")}
    put(f"{tmp_path}/lists/trainfiles.txt", "a\nb\n")
    got = text.read_fileset_lists(spark, f"{tmp_path}/lists/*.txt", "files").collect()
    assert {tuple(r) for r in got} == {("a", "train"), ("b", "train")}
    items = spark.createDataFrame(
        [("u1", 0.01, 0.25, "p", "a_b", "s")],
        "utt string, onset double, offset double, phone string, context string, speaker string",
    )
    text.write_items(items, f"{tmp_path}/items")
    assert text.read_items(spark, f"{tmp_path}/items").collect() == items.collect()
    scores = spark.createDataFrame([("p", "q", "c", 0.5, 4)], "phone_1 string, phone_2 string, context string, score double, n bigint")
    text.write_scores(scores, f"{tmp_path}/scores")
    assert text.read_scores(spark, f"{tmp_path}/scores").collect() == scores.collect()


def test_store(spark, tmp_path, make_frames, collect):
    series = {"s_1": RNG.normal(size=(20, 2)), "t_1": RNG.normal(size=(30, 2))}
    path = f"{tmp_path}/store"
    store.write_features(make_frames(series), path, "c", "mfcc")
    name = extraction.normalize_kind(spark, path, "c", "mfcc", "stds", "speaker", 2)
    assert name == "stds_byspeaker"
    got = collect(store.read_features(spark, path, "c", "mfcc_stds_byspeaker"))
    for utt, x in series.items():
        np.testing.assert_allclose(got[utt], (x - x.mean(0)) / x.std(0), atol=1e-12)
    np.testing.assert_array_equal(collect(store.read_features(spark, path, "c", "mfcc"))["s_1"], series["s_1"])
    plan = store.read_features(spark, path, "c", "mfcc_stds_byspeaker")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan
    table = mo.all_scopes(make_frames(series).withColumn("speaker", F.substring_index("utt", "_", 1)))
    store.write_moments(table, f"{tmp_path}/moments", "c", "mfcc")
    back = store.read_moments(spark, f"{tmp_path}/moments", "c", "mfcc", "speaker", "s").orderBy("channel")
    np.testing.assert_allclose([r["mean"] for r in back.collect()], series["s_1"].mean(0))
    store.write_channels(spark, ["b ", "a"], f"{tmp_path}/channels", "c")
    assert store.read_channels(spark, f"{tmp_path}/channels", "c") == ["b", "a"]
    store.write_timed_features(make_frames(series), f"{tmp_path}/timed", 50)
    rows = spark.read.parquet(f"{tmp_path}/timed").where("frame_ix = 5").collect()
    assert {r["time"] for r in rows} == {0.1}


def corpus(folder):
    """A tiny corpus in the layout of the single-speaker one."""
    for k in (1, 2):
        n = 200 + 20 * k
        data = RNG.normal(size=(n, 14)).cumsum(axis=0)
        data[50:53, 0] = np.nan
        names = corpora.Mngu0("").default_articulators + ["x1", "x2"]
        put(f"{folder}/ema_basic_data/m_{k}.ema", est_bytes(data, names))
        x = RNG.normal(size=16000 * n // 200) * 0.1
        put(f"{folder}/wav_16kHz/m_{k}.wav", wav_bytes(x, 16000))
        put(f"{folder}/phone_labels/m_{k}.lab",
            "h\n#\n" + "".join(f"\t {t} 26 \t{s}\n" for t, s in
                               ((0.1, "#"), (0.3, "a"), (0.55, "s"), (0.8, "a"), (1.0, "#"))))


def test_extraction_end_to_end(spark, tmp_path, collect):
    corpus(str(tmp_path))
    adapter = corpora.Mngu0(str(tmp_path))
    chart = spark.createDataFrame([("#", 0.0), ("a", 1.0), ("s", 0.0)], "mngu0 string, voiced double")
    kinds = extraction.extract(spark, adapter, chart, ["mfcc", "lpc"], [5, 4])
    got = {k: collect(v) for k, v in kinds.items()}
    assert set(got) == {"mfcc", "lpc", "ema", "voicing"}
    widths = {"mfcc": 15, "lpc": 15, "ema": 12, "voicing": 1}
    for kind, series in got.items():
        assert sorted(series) == ["m_1", "m_2"]
        for x in series.values():
            assert x.shape == (70, widths[kind]) and np.isfinite(x).all()
    np.testing.assert_array_equal(
        got["voicing"]["m_1"][:, 0], [1] * 20 + [0] * 25 + [1] * 25
    )
    extraction.store_extracted({"voicing": kinds["voicing"]}, f"{tmp_path}/out", "mngu0")
    assert store.read_features(spark, f"{tmp_path}/out", "mngu0", "voicing").count() == 140
    assert sorted(r["utt"] for r in adapter.utterances(spark).collect()) == ["m_1", "m_2"]


def test_two_speaker_corpus(spark, tmp_path, collect):
    data = RNG.normal(size=(250, 4)).cumsum(axis=0) * 1000
    names = ["tt_x", "tt_y", "v_x ", "v_y "]
    put(f"{tmp_path}/fsew0/fsew0_001.ema", est_bytes(data, names))
    x = RNG.normal(size=8200) * 0.1
    for suffix in ("wav", "lar"):
        put(f"{tmp_path}/fsew0/fsew0_001.{suffix}", sphere_bytes(x, 16000))
    adapter = corpora.Mocha(str(tmp_path))
    assert adapter.channel_names(spark) == ["tt_x", "tt_y", "v_x", "v_y", "larynx"]
    ema = collect(adapter.ema(spark, ["v_x", "tt_y"]))["fsew0_001"]
    assert ema.shape == (250, 2)
    full = collect(adapter.ema(spark, None))["fsew0_001"]
    assert full.shape == (250, 5)
    np.testing.assert_allclose(full[:, [2, 1]], ema, atol=1e-9)
    with pytest.raises(KeyError):
        adapter.utterances(spark, "nobody")
    assert [tuple(r) for r in adapter.utterances(spark, "fsew0").collect()] == [("fsew0", "fsew0_001")]


def test_text_corpus(spark, tmp_path, collect):
    adapter = corpora.Mspka(str(tmp_path))
    data = RNG.integers(-50, 50, size=(21, 12)).astype(float)
    for n in (2, 10):
        put(f"{tmp_path}/cnz_1.0.0/ema_1.0.0/cnz_{n}.ema", "\n".join(" ".join(map(str, r)) for r in data))
        put(f"{tmp_path}/cnz_1.0.0/lab_1.0.0/cnz_{n}.lab", "0 0.2 sil\n0.2 0.3 k cat\n")
    assert [r["utt"] for r in adapter.utterances(spark).collect()] == ["cnz_2", "cnz_10"]
    ema = collect(adapter.ema(spark, ["ul_x", "tt_z"]))
    np.testing.assert_allclose(ema["cnz_2"], data[[0, 20]].T / 10)
    assert adapter.phones(spark).count() == 4


def test_provided_filesets(spark, tmp_path):
    corpus(str(tmp_path))
    put(f"{tmp_path}/ema_filesets/trainfiles.txt", "m_1\n")
    put(f"{tmp_path}/ema_filesets/testfiles.txt", "m_2\n")
    got = corpora.Mngu0(str(tmp_path)).provided_filesets(spark).collect()
    assert {tuple(r) for r in got} == {("m_1", "train_initial"), ("m_2", "test_initial")}


def test_extraction_arguments():
    check = extraction.checked_arguments
    assert check(None, 13, 100, 25) == (["lpc", "lsf", "mfcc"], [13] * 3)
    assert check("mfcc", [12], 100, 25) == (["mfcc"], [12])
    for bad in ((["plp"], 13, 100, 25), ):
        with pytest.raises(ValueError):
            check(*bad)
    for bad in ((None, [1, 2], 100, 25), (None, 0, 100, 25), (None, 13, -1, 25), (None, 13, 100, 2.5)):
        with pytest.raises(TypeError):
            check(*bad)


def test_voicing_unknown_symbol_fails(spark):
    phones = spark.createDataFrame([("u", 0, 0.1, "zz")], "utt string, phone_ix int, t_end double, symbol string")
    chart = spark.createDataFrame([("#", 0.0)], "symbol string, voiced double")
    with pytest.raises(Exception, match="not in the chart"):
        ph.voicing(phones, chart, 100).collect()


def test_short_features_fail(spark, make_frames):
    bounds = spark.createDataFrame([("u", 10, 20)], "utt string, start_ix int, end_ix int")
    with pytest.raises(Exception, match="end before the speech"):
        ph.common_bounds({"ema": make_frames({"u": np.ones((5, 1))})}, bounds).collect()
    got = ph.common_bounds({"ema": make_frames({"u": np.ones((15, 1))})}, bounds).collect()
    assert [tuple(r) for r in got] == [("u", 10, 15)]


def test_feature_source_rules(make_frames, collect):
    frames = make_frames({"u": RNG.normal(size=(12, 2))}).withColumn("speaker", F.lit("u"))
    kinds, widths, names = {"mfcc": frames, "ema": frames}, {"mfcc": 2, "ema": 2}, ["a", "b"]
    for bad in ({}, {"invert": lambda f: f, "ema_features": ""},
                {"invert": lambda f: f, "audio_features": "mfcc", "ema_features": "", "input_width": 2}):
        with pytest.raises(RuntimeError):
            abx_features(kinds, widths, names, **bad)
    both = abx_features(kinds, widths, names, audio_features="mfcc", ema_features="",
                        articulators=["b"], dynamic_ema=False)
    assert collect(both)["u"].shape == (12, 3)
    assert both.where("frame_ix = 7").collect()[0]["time"] == 0.07
    seen = []
    abx_features(kinds, widths, names, audio_features="mfcc", input_width=22,
                 invert=lambda f: seen.append(len(f.first()["feats"])) or f)
    abx_features(kinds, widths, names, audio_features="mfcc", input_width=2,
                 invert=lambda f: seen.append(len(f.first()["feats"])) or f)
    assert seen == [22, 2]


def test_loading_rules(make_frames):
    frames = make_frames({"u": RNG.normal(size=(12, 2))}).withColumn("speaker", F.lit("u"))
    kinds, widths = {"mfcc": frames, "ema": frames}, {"mfcc": 2, "ema": 2}
    setup = LoadingSetup(articulators=["a"], context_window=2, zero_padding=False, ema_norm="")
    rows = load_dataset(kinds, widths, ["a", "b"], setup).orderBy("frame_ix").collect()
    assert [r["frame_ix"] for r in rows] == list(range(8))
    assert {(len(r["acoustic"]), len(r["ema"])) for r in rows} == {(10, 3)}
    with pytest.raises(ValueError, match="voicing"):
        load_dataset(kinds, widths, ["a", "b"], LoadingSetup(ema_norm=""))
    with pytest.raises(KeyError):
        load_dataset(kinds, widths, ["a", "b"], LoadingSetup(articulators=["zz"], ema_norm=""))
    assert parse_norm("spread_byfile") == ("spread", "file")
    with pytest.raises(ValueError):
        parse_norm("stds_bytown")
    assert LoadingSetup.by_speaker().audio_type == "mfcc_stds_byspeaker"


def test_energy_is_cut_to_the_shorter(spark):
    x = RNG.normal(size=1000)
    rows = spark.createDataFrame(
        [("u", i, float(v)) for i, v in enumerate(x)], "utt string, sample_ix int, value double")
    audio = sg.blocks(rows)
    assert sg.get_lpc(audio, 1000, 100, 50, 4).count() == 1 + (1000 - 100) // 50


def test_inversion_from_file_to_file(spark, tmp_path, make_frames, collect):
    from framelark.operators import models as md
    from framelark.plans.inversion import run_inversion

    m = md.DenseModel([], md.Dense(RNG.normal(size=(6, 3)), RNG.normal(size=3), "identity"))
    series = {"u1": RNG.normal(size=(9, 2)), "u2": RNG.normal(size=(4, 2))}
    text.write_ark(make_frames(series), f"{tmp_path}/in.txt")
    make_frames(series).write.parquet(f"{tmp_path}/in")
    run_inversion(spark, f"{tmp_path}/in.txt", m, f"{tmp_path}/out", 2, "ark", 1, [2, 0])
    run_inversion(spark, f"{tmp_path}/in", m, f"{tmp_path}/out.txt", 2, "parquet", 1, [2, 0])
    got, other = collect(spark.read.parquet(f"{tmp_path}/out")), collect(text.read_ark(spark, f"{tmp_path}/out.txt"))
    for utt, x in series.items():
        pad = np.vstack([np.zeros((1, 2)), x, np.zeros((1, 2))])
        want = m.output(np.hstack([pad[i:i + len(x)] for i in range(3)]))[:, [2, 0]]
        np.testing.assert_allclose(got[utt], want)
        np.testing.assert_allclose(other[utt], want)
    with pytest.raises(TypeError):
        run_inversion(spark, f"{tmp_path}/in", m, f"{tmp_path}/out.ark", 2)
    with pytest.raises(ValueError):
        run_inversion(spark, f"{tmp_path}/in", m, f"{tmp_path}/out2", 2, "h5")


def test_discrimination_of_a_corpus(spark):
    from framelark.operators.abx import collapsed
    from framelark.plans.discrimination import abx_from_features, make_items

    rows, feats = [], []
    for u in range(6):
        for i, s in enumerate(["#", "x", "aa", "y", "#"] if u % 2 else ["#", "x", "bb", "y", "#"]):
            rows.append((f"s_{u}", i, 0.1 * (i + 1), s))
        for t in range(40):
            feats.append((f"s_{u}", t, [1.0, 0.1 * u] if u % 2 else [0.1 * u, 1.0]))
    phones = spark.createDataFrame(rows, "utt string, phone_ix int, t_end double, symbol string")
    features = spark.createDataFrame(feats, "utt string, frame_ix int, feats array<double>")
    chart = spark.createDataFrame(
        [("#", "#", "#", "#"), ("x", "X", "C", "ks"), ("aa", "A", "V", "ɑ"), ("bb", "B", "V", None), ("y", "Y", "C", "j")],
        "toy string, common string, common_reduced string, ipa string")
    items = make_items(phones, chart, "toy")
    assert {r["phone"] for r in items.collect()} == {"X", "A", "B", "Y"}
    scores = abx_from_features(features, items, chart, 2).collect()
    assert {(r["phone_1"], r["phone_2"]) for r in scores} == {("ɑ", None), (None, "ɑ")}
    assert all(r["context"] == "X_Y" and r["n"] == 3 * 2 * 3 for r in scores)
    plain = collapsed(abx_from_features(features, items, chart, 2, False, ipa=False)).collect()
    assert [(r["phones"], r["n"]) for r in plain] == [("A_B", 36)]
    sets = spark.createDataFrame([("s_1", "test")], "utt string, set_name string")
    reduced = make_items(phones, chart, "toy", True, sets, "test").collect()
    assert [r["phone"] for r in sorted(reduced, key=lambda r: r["phone_ix"])] == ["C", "V", "C"]

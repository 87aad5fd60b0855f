"""Byte-range sources and archive sinks."""

import glob
import os
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import NullType, StructField, StructType
from test_sources import est_bytes, put, sphere_bytes, wav_bytes

from framelark.sources import archives, binary, ranges, text
from framelark.sources.ranges import read_ranges

RNG = np.random.default_rng(2)


def decode(form, path, range_bytes, names, **options):
    """All rows through the reader's own partitions, without a session."""
    options = {"path": str(path), "format": form, "range_bytes": str(range_bytes), **options}
    reader = ranges.RangeReader(options, StructType([StructField(n, NullType()) for n in names]))
    parts = reader.partitions()
    return pa.Table.from_batches([b for p in parts for b in reader.read(p)]), len(parts)


@pytest.mark.parametrize("kind, order", [("binary", "01"), ("binary", "10"), ("ascii", "01")])
def test_tracks_cut_at_any_byte(tmp_path, monkeypatch, kind, order):
    monkeypatch.setattr(ranges, "BATCH_BYTES", 64)
    data = RNG.normal(size=(23, 3)).astype("f4").astype(float)
    put(f"{tmp_path}/a/u1.ema", est_bytes(data, ["x", "y", "z "], kind, order))
    put(f"{tmp_path}/b/u2.ema", est_bytes(data[:0], ["x", "y", "z"], kind, order))
    put(f"{tmp_path}/_hidden/u3.ema", b"left out")
    size = os.path.getsize(f"{tmp_path}/a/u1.ema")
    for range_bytes in [*range(1, 40), 100, size - 1, size, size + 1]:
        rows, parts = decode("est", tmp_path, range_bytes, ["utt", "frame_ix", "time", "feats"])
        assert parts >= -(-size // range_bytes)
        assert rows["utt"].to_pylist() == ["u1"] * 23
        assert rows["frame_ix"].to_pylist() == list(range(23))
        np.testing.assert_allclose(rows["feats"].to_pylist(), data, rtol=1e-6)
        np.testing.assert_allclose(rows["time"].to_pylist(), np.arange(23) / 500, rtol=1e-6)
    rows, _ = decode("est", tmp_path, 50, ["feats"], channels="z,x")
    assert rows.column_names == ["feats"]
    np.testing.assert_allclose(rows["feats"].to_pylist(), data[:, [2, 0]], rtol=1e-6)


@pytest.mark.parametrize("width, channels", [(1, 1), (2, 1), (2, 2), (3, 1), (4, 1)])
def test_wav_cut_at_any_byte(tmp_path, width, channels):
    samples = RNG.integers(-100, 100, 71 * channels)
    raw = b"".join(
        int(s + 128 if width == 1 else s).to_bytes(width, "little", signed=width > 1) for s in samples)
    form = struct.pack("<HHIIHH", 1, channels, 8000, 8000 * width * channels, width * channels, 8 * width)
    extra = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    for length in (len(raw), 0xFFFFFFFF):  # a stream's size is unknown when its header is written
        chunks = b"fmt " + struct.pack("<I", 16) + form + extra + b"data" + struct.pack("<I", length) + raw
        put(f"{tmp_path}/s.wav", b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks)
        expected = (samples / 2.0 ** (8 * width - 1)).reshape(-1, channels).mean(axis=1)
        for range_bytes in [1, 7, 64, 100_000]:
            rows, _ = decode("wav", tmp_path, range_bytes, ["utt", "sr", "block_ix", "samples"], block="10")
            assert rows["block_ix"].to_pylist() == list(range(8)) and set(rows["sr"].to_pylist()) == {8000}
            assert [len(s) for s in rows["samples"].to_pylist()] == [10] * 7 + [1]
            np.testing.assert_allclose(np.concatenate(rows["samples"].to_pylist()), expected)


@pytest.mark.parametrize("order", ["01", "10"])
def test_sphere_cut_at_any_byte(tmp_path, order):
    x = np.sin(np.arange(333) / 7) / 2
    put(f"{tmp_path}/s.wav", sphere_bytes(x, 16000, order))
    for range_bytes in (13, 400, 1024, 5000):
        rows, _ = decode("sphere", tmp_path, range_bytes, ["sr", "block_ix", "samples"], block="50")
        assert rows["block_ix"].to_pylist() == list(range(7)) and set(rows["sr"].to_pylist()) == {16000}
        np.testing.assert_allclose(np.concatenate(rows["samples"].to_pylist()), x, atol=1e-4)


@pytest.mark.parametrize("kind", ["f8", "f4", "i2", ">f8"])
def test_npy_cut_at_any_byte(tmp_path, kind):
    data = (RNG.normal(size=(31, 4)) * 100).astype(kind)
    np.save(f"{tmp_path}/u_mfcc.npy", data)
    for range_bytes in (1, 9, 128, 129, 10_000):
        rows, _ = decode("npy", tmp_path, range_bytes, ["utt", "frame_ix", "feats"], kind="mfcc")
        assert rows["utt"].to_pylist() == ["u"] * 31 and rows["frame_ix"].to_pylist() == list(range(31))
        np.testing.assert_array_equal(rows["feats"].to_pylist(), data.astype(float))


def test_bad_files(tmp_path):
    def fails(name, content, kind, match, **options):
        put(f"{tmp_path}/{name}/u{ranges.SUFFIXES[kind]}", content)
        with pytest.raises(ValueError, match=match):
            decode(kind, f"{tmp_path}/{name}", 1000, ["feats"], **options)

    fails("magic", b"something else", "est", "not an EST")
    fails("open", b"EST_File Track\nNumFrames 2\n", "est", "header")
    fails("short", est_bytes(np.ones((5, 2)), ["a", "b"])[:-4], "est", "expected 5 rows")
    fails("ascii", est_bytes(np.ones((5, 2)), ["a", "b"], "ascii")[:-4], "est", "expected 5 rows")
    fails("names", est_bytes(np.ones((5, 2)), ["a", "b"]), "est", "no channel c", channels="a,c")
    fails("riff", b"RIFX" + bytes(40), "wav", "not a wav")
    fails("coding", sphere_bytes(np.zeros(4), 8000).replace(b"coding -s3 pcm", b"coding -s4 ulaw"), "sphere", "coding")
    with pytest.raises(FileNotFoundError):
        decode("est", f"{tmp_path}/nowhere", 1000, ["feats"])
    with pytest.raises(ValueError, match="format must be"):
        decode("mp3", tmp_path, 1000, ["feats"])


def test_source_in_a_session(spark, tmp_path):
    data = RNG.normal(size=(40, 2)).astype("f4").astype(float)
    for i in range(3):
        put(f"{tmp_path}/t/u{i}.ema", est_bytes(data + i, ["a", "b"]))
    rows = read_ranges(spark, f"{tmp_path}/t", "est", range_bytes=200)
    whole = binary.read_est(spark, f"{tmp_path}/t")
    assert rows.schema == whole.schema and rows.rdd.getNumPartitions() > 6
    assert rows.exceptAll(whole).isEmpty() and whole.exceptAll(rows).isEmpty()
    narrow = read_ranges(spark, f"{tmp_path}/t", "est", ["frame_ix"])
    assert narrow.columns == ["frame_ix"] and narrow.agg(F.sum("frame_ix")).first()[0] == 3 * 780
    put(f"{tmp_path}/t/u9.ema", b"not a track")  # a file that is filtered out is not opened
    spark.conf.set(ranges.PUSHDOWN, "true")
    try:
        picked = read_ranges(spark, f"{tmp_path}/t", "est").where(F.col("utt").isin("u1", "u2"))
        assert picked.where("utt = 'u2'").count() == 40 and picked.count() == 80
        assert read_ranges(spark, f"{tmp_path}/t", "est").where("utt = 'none'").count() == 0
    finally:
        spark.conf.unset(ranges.PUSHDOWN)


def test_audio_source_equals_whole_files(spark, tmp_path):
    put(f"{tmp_path}/w/s_1.wav", wav_bytes(np.sin(np.arange(20_000) / 9) / 2, 16000))
    rows = read_ranges(spark, f"{tmp_path}/w", "wav", range_bytes=3_000, block=4_000)
    whole = binary.read_audio(spark, f"{tmp_path}/w", block=4_000)
    assert rows.schema == whole.schema
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, whole.collect()))


# --- sinks --------------------------------------------------------------------


def archive(path):
    """The parts of an archive in name order, as one text."""
    return "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*")))


@pytest.mark.parametrize("partitions", [1, 4, 50])
def test_ark_archive(spark, make_frames, tmp_path, partitions):
    """A hot utterance goes on over several parts, others share one."""
    series = {"b": RNG.normal(size=(60, 2)), "a": RNG.normal(size=(1, 2)), "c d": RNG.normal(size=(7, 2))}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        archives.write_ark_archive(make_frames(series), f"{tmp_path}/x")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.enabled")
    blocks = [
        f"{utt} [\n" + "\n".join(" ".join(repr(float(v)) for v in row) for row in series[utt]) + " ]\n"
        for utt in sorted(series)]
    assert archive(f"{tmp_path}/x") == "".join(blocks)
    assert "_SUCCESS" in os.listdir(tmp_path / "x")
    back = text.read_ark(spark, f"{tmp_path}/x").collect()
    for utt, data in series.items():
        rows = sorted((r["frame_ix"], r["feats"]) for r in back if r["utt"] == utt)
        np.testing.assert_array_equal([f for _, f in rows], data)


def test_archives_of_no_rows_and_nulls(spark, tmp_path):
    schema = "utt string, frame_ix int, feats array<double>"
    archives.write_ark_archive(spark.createDataFrame([], schema), f"{tmp_path}/none")
    assert archive(f"{tmp_path}/none") == "" and text.read_ark(spark, f"{tmp_path}/none").count() == 0
    rows = [("u", 0, [1.0, None]), ("u", 1, [float("nan"), float("inf")])]
    archives.write_ark_archive(spark.createDataFrame(rows, schema), f"{tmp_path}/odd")
    assert archive(f"{tmp_path}/odd") == "u [\n1.0 nan\nnan inf ]\n"
    items = "utt string, onset double, offset double, phone string, context string, speaker string"
    archives.write_item_archive(spark.createDataFrame([], items), f"{tmp_path}/items")
    assert archive(f"{tmp_path}/items") == archives.ITEM_HEADER + "\n"
    assert text.read_item_archive(spark, f"{tmp_path}/items").count() == 0


def test_item_archive(spark, tmp_path):
    rows = [(f"u{i % 3}", i / 10, i / 10 + 0.05, "k", "a_b", "s1") for i in range(30)]
    schema = "utt string, onset double, offset double, phone string, context string, speaker string"
    archives.write_item_archive(spark.createDataFrame(rows, schema).repartition(5), f"{tmp_path}/i")
    lines = archive(f"{tmp_path}/i").splitlines()
    assert lines[0] == "#file onset offset #phone context speaker" and lines[1] == "u0 0.0 0.05 k a_b s1"
    assert sorted(map(tuple, text.read_item_archive(spark, f"{tmp_path}/i").collect())) == sorted(rows)


def test_existing_target_is_refused(spark, make_frames, tmp_path):
    frames = make_frames({"a": np.ones((2, 1))})
    archives.write_ark_archive(frames, f"{tmp_path}/x")
    before = archive(f"{tmp_path}/x")
    with pytest.raises(Exception, match="exists"):
        archives.write_ark_archive(frames, f"{tmp_path}/x")
    with pytest.raises(Exception, match="exists"):
        archives.write_arrays(frames, f"{tmp_path}/x")
    assert archive(f"{tmp_path}/x") == before


def test_failing_task_leaves_nothing(spark, make_frames, tmp_path):
    frames = make_frames({f"u{i}": np.ones((20, 1)) for i in range(20)})
    broken = frames.withColumn("feats", F.when(
        (F.col("utt") == "u7") & (F.col("frame_ix") == 11), F.raise_error(F.lit("broken frame"))
    ).otherwise(F.col("feats")))
    for write in (archives.write_ark_archive, archives.write_arrays):
        with pytest.raises(Exception, match="broken frame"):
            write(broken, f"{tmp_path}/x")
        assert not os.path.exists(f"{tmp_path}/x")
    with pytest.raises(Exception, match="cannot name a file"):
        archives.write_arrays(make_frames({"a/b": np.ones((1, 1)), "c": np.ones((5, 1))}), f"{tmp_path}/y")
    assert not os.path.exists(f"{tmp_path}/y")


def test_files_per_utterance(spark, make_frames, tmp_path):
    series = {f"u{i}": RNG.normal(size=(i * 9 + 1, 3)) for i in range(6)}
    frames = make_frames(series)
    archives.write_arrays(frames, f"{tmp_path}/npy")
    archives.write_tracks(frames, f"{tmp_path}/est", ["x", "y", "z"], 500)
    archives.write_recordings(
        frames.select("utt", "frame_ix", (F.col("feats")[0] / 8).alias("value")), f"{tmp_path}/wav", 8000)
    for utt, data in series.items():
        np.testing.assert_array_equal(np.load(f"{tmp_path}/npy/{utt}.npy"), data)
        names, track = binary.decode_est(open(f"{tmp_path}/est/{utt}.ema", "rb").read())
        assert names == ["x", "y", "z"]
        np.testing.assert_allclose(track[:, 2:], data, rtol=1e-6)
        np.testing.assert_allclose(track[:, 0], np.arange(len(data)) / 500, rtol=1e-6)
        rate, x = binary.decode_wav(open(f"{tmp_path}/wav/{utt}.wav", "rb").read())
        assert rate == 8000
        np.testing.assert_allclose(x, data[:, 0] / 8, atol=1e-4)


def test_many_ranges_and_files_are_dealt_to_few_tasks(spark, tmp_path):
    (tmp_path / "n").mkdir()
    for i in range(300):
        np.save(tmp_path / "n" / f"a{i}.npy", np.arange(20.0).reshape(10, 2) + i)
    rows = read_ranges(spark, f"{tmp_path}/n", "npy", range_bytes=50)
    assert rows.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism + 1
    got = sorted((r["utt"], r["frame_ix"], tuple(r["feats"])) for r in rows.collect())
    assert got == sorted(
        (f"a{i}", j, (2.0 * j + i, 2.0 * j + 1 + i)) for i in range(300) for j in range(10))


def test_dealt_ranges_are_all_read_once_and_bounded():
    files = [("a", 1_000_000), ("b", 5), ("c", 0), ("d", 3_000_000), ("e", 700)]
    cuts = [ranges.FileRange(p, n, at, min(at + 1_000, n))
              for p, n in files for at in range(0, max(n, 1), 1_000)]
    for tasks, most in ((1, 10**9), (7, 10**9), (3, 600_000), (10**9, 10**9)):
        parts = ranges.dealt(cuts, tasks, most)
        pieces = [piece for part in parts for piece in part.pieces]
        at = iter(pieces)
        for path, size in files:
            end = 0
            while True:
                piece = next(at)
                assert (piece.path, piece.size, piece.begin) == (path, size, end)
                end = piece.end
                if end >= size:
                    break
        assert next(at, None) is None
        for part in parts:
            cost = sum(p.end - p.begin + ranges.OPEN_BYTES for p in part.pieces)
            assert cost <= most or len(part.pieces) == 1 and cost <= 1_000 + ranges.OPEN_BYTES

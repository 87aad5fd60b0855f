"""Binary recordings: PCM and SPHERE audio, EST tracks, npy arrays.

A file is one row of the ``binaryFile`` source (Spark bounds it at 2 GB) and is
decoded in the task that reads it; what comes out are bounded blocks or frames.
"""

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelark.operators.models import list_column
from framelark.operators.signals import BLOCK, blocks, resample
from framelark.sources.text import file_stem

ROWS_PER_BATCH = 20_000


def _files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}")
        .option("recursiveFileLookup", "true").load(path)
        .select(file_stem(F.col("path")).alias("utt"), "content")
    )


def _decoded(
    files: DataFrame, decode: Callable[[str, bytes], Iterator[dict]], schema: str
) -> DataFrame:
    """Rows of each file, as batches of Arrow columns (NaN stays NaN there)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for utt, content in zip(batch["utt"], batch["content"]):
                for columns in decode(utt.as_py(), content.as_py()):
                    yield pa.RecordBatch.from_pydict(columns)

    return files.mapInArrow(run, schema)


def _frame_batches(utt: str, data: np.ndarray) -> Iterator[tuple[dict, np.ndarray]]:
    """Key columns of a matrix's rows, a bounded number at a time."""
    for first in range(0, len(data), ROWS_PER_BATCH):
        part = data[first:first + ROWS_PER_BATCH]
        ix = np.arange(first, first + len(part), dtype=np.int32)
        yield {"utt": pa.array([utt] * len(part)), "frame_ix": pa.array(ix)}, part


# --- audio ------------------------------------------------------------------


def _pcm(data: bytes, width: int, channels: int, order: str = "<") -> np.ndarray:
    """Integer samples to [-1, 1), channels averaged."""
    if width == 1:
        x = np.frombuffer(data, np.uint8).astype(float) - 128
    elif width == 3:
        raw = np.frombuffer(data, np.uint8).reshape(-1, 3)[:, :: 1 if order == "<" else -1]
        x = (np.pad(raw, ((0, 0), (1, 0))).copy().view("<i4").ravel() >> 8).astype(float)
    else:
        x = np.frombuffer(data, f"{order}i{width}").astype(float)
    x /= 2.0 ** (8 * width - 1)
    return x.reshape(-1, channels).mean(axis=1) if channels > 1 else x


def decode_wav(content: bytes) -> tuple[int, np.ndarray]:
    with wave.open(io.BytesIO(content)) as file:
        data = file.readframes(file.getnframes())
        return file.getframerate(), _pcm(data, file.getsampwidth(), file.getnchannels())


def decode_sphere(content: bytes) -> tuple[int, np.ndarray]:
    """An ascii header of stated size, then plain samples."""
    magic, size = content[:16].decode("ascii").split("\n")[:2]
    if magic != "NIST_1A":
        raise ValueError("not a SPHERE file")
    header = {}
    for line in content[16:int(size)].decode("ascii", "replace").split("\n"):
        parts = line.split(" ", 2)
        if parts[0] == "end_head":
            break
        if len(parts) == 3:
            header[parts[0]] = parts[2]
    if not header.get("sample_coding", "pcm").startswith("pcm") or "," in header.get("sample_coding", ""):
        raise ValueError(f"unsupported SPHERE coding {header['sample_coding']}")
    order = ">" if header.get("sample_byte_format", "01") == "10" else "<"
    data = content[int(size):]
    width, channels = int(header["sample_n_bytes"]), int(header.get("channel_count", 1))
    data = data[: int(header["sample_count"]) * width * channels]
    return int(header["sample_rate"]), _pcm(data, width, channels, order)


def read_audio(
    spark: SparkSession, path: str, decode: Callable = decode_wav, suffix: str = ".wav",
    block: int = BLOCK,
) -> DataFrame:
    """``(utt, sr, block_ix, samples)``."""
    def rows(utt: str, content: bytes) -> Iterator[dict]:
        rate, x = decode(content)
        for first in range(0, len(x), block):
            yield {
                "utt": pa.array([utt]), "sr": pa.array([rate], pa.int32()),
                "block_ix": pa.array([first // block], pa.int64()),
                "samples": list_column(x[None, first:first + block]),
            }

    return _decoded(
        _files(spark, path, suffix), rows,
        "utt string, sr int, block_ix bigint, samples array<double>",
    )


def audio_at_rate(
    audio: DataFrame, rates: list[int], to_rate: int, block: int = BLOCK
) -> DataFrame:
    """Bring audio of the listed rates to one rate; another rate fails the job."""
    message = F.concat(
        F.col("utt"), F.lit(f": a sampling rate not among {sorted(rates)}: "),
        F.col("sr").cast("string"),
    )
    audio = audio.withColumn(
        "sr", F.when(F.col("sr").isin(rates), F.col("sr")).otherwise(F.raise_error(message))
    )
    parts = []
    for rate in rates:
        rows = audio.where(F.col("sr") == rate)
        if rate != to_rate:
            cells = rows.select(
                "utt", "block_ix", F.posexplode("samples").alias("_i", "x")
            ).select(
                "utt", (F.col("block_ix") * block + F.col("_i")).cast("int").alias("frame_ix"),
                F.array("x").alias("feats"),
            )
            moved = resample(cells, rate, to_rate, width=1)
            rows = blocks(
                moved.select("utt", F.col("frame_ix").alias("sample_ix"),
                             F.get("feats", F.lit(0)).alias("value")), block=block,
            ).select("utt", F.lit(to_rate).alias("sr"), "block_ix", "samples")
        parts.append(rows)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- EST tracks -------------------------------------------------------------


def decode_est(content: bytes) -> tuple[list[str], np.ndarray]:
    """Channel names and the table (time, validity, channels)."""
    stop = content.find(b"EST_Header_End")
    head = content[:stop].decode("latin-1").split("\n")
    if head[0].strip() != "EST_File Track" or stop < 0:
        raise ValueError("not an EST track file")
    kind, order, names = "binary", "<", {}
    n_frames = n_channels = 0
    for line in head[1:]:
        key, _, value = line.strip().partition(" ")
        value = value.strip()
        if key == "DataType":
            kind = value
        elif key == "ByteOrder":
            order = {"01": "<", "10": ">"}[value]
        elif key == "NumFrames":
            n_frames = int(value)
        elif key == "NumChannels":
            n_channels = int(value)
        elif key.startswith("Channel_"):
            names[int(key[len("Channel_"):])] = value
    body = content[content.index(b"\n", stop) + 1:]
    if kind == "binary":
        data = np.frombuffer(body[: len(body) // 4 * 4], f"{order}f4").astype(float)
    elif kind == "ascii":
        data = np.array(body.split(), dtype=float)
    else:
        raise ValueError(f"unknown data type {kind!r}")
    if data.size != n_frames * (n_channels + 2):
        raise ValueError(
            f"expected {n_frames} rows of {n_channels + 2} values, got {data.size} values"
        )
    return [names[i] for i in sorted(names)], data.reshape(n_frames, n_channels + 2)


def read_est(
    spark: SparkSession, path: str, suffix: str = ".ema", names: list[str] | None = None
) -> DataFrame:
    """``(utt, frame_ix, time, feats)``.

    With ``names``, the channels of those names by each file's own header, in
    the asked order; a file without one of them fails the job.
    """
    def rows(utt: str, content: bytes) -> Iterator[dict]:
        found, data = decode_est(content)
        if names is not None:
            place = {name.strip(): i + 2 for i, name in enumerate(found)}
            missing = sorted(set(names) - set(place))
            if missing:
                raise ValueError(f"{utt}: no channel {', '.join(missing)}")
            data = data[:, [0, 1, *[place[name] for name in names]]]
        for keys, part in _frame_batches(utt, data):
            yield {**keys, "time": pa.array(part[:, 0]), "feats": list_column(part[:, 2:])}

    return _decoded(
        _files(spark, path, suffix), rows,
        "utt string, frame_ix int, time double, feats array<double>",
    )


def est_channels(spark: SparkSession, path: str, suffix: str = ".ema") -> DataFrame:
    """``(utt, channel, name)`` out of the headers."""
    def rows(utt: str, content: bytes) -> Iterator[dict]:
        names = decode_est(content)[0]
        yield {
            "utt": pa.array([utt] * len(names)),
            "channel": pa.array(np.arange(len(names), dtype=np.int32)), "name": pa.array(names),
        }

    return _decoded(
        _files(spark, path, suffix), rows, "utt string, channel int, name string"
    )


# --- npy arrays -------------------------------------------------------------


def read_npy(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """``(utt, frame_ix, feats)`` of a folder of arrays.

    Names end in ``_<kind>`` when a kind is given; the utterance is the rest.
    """
    def arrays(utt: str, content: bytes) -> Iterator[dict]:
        data = np.load(io.BytesIO(content), allow_pickle=False).astype(float)
        for keys, part in _frame_batches(utt, data.reshape(len(data), -1)):
            yield {**keys, "feats": list_column(part)}

    rows = _decoded(
        _files(spark, path, ".npy"), arrays, "utt string, frame_ix int, feats array<double>"
    )
    if kind is None:
        return rows
    return rows.withColumn("utt", F.regexp_replace("utt", f"_{kind}$", ""))

"""Ordered archives and files per utterance, as a Python data source for writing.

Tasks write their parts into a staging folder inside the target; the driver
moves them into place when all have succeeded. A failed job leaves nothing
behind, a repeated task's leftovers go with the staging folder, and an existing
target is refused.

*Ordered* formats (``ark``, ``items``) are one text over several files in name
order. Rows come range-partitioned and sorted, so an utterance may go on in the
next task's part. What stands between two parts (closing and opening marks)
depends on both: each task hands its first utterance and its last line to the
driver with its commit message, and the driver writes the small piece between.

*File* formats (``est``, ``npy``, ``wav``) are one file per utterance.
"""

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from framelark.operators.frames import with_length
from framelark.sources.ranges import open_path

SUFFIXES = {"ark": ".txt", "items": ".txt", "est": ".ema", "npy": ".npy", "wav": ".wav"}
ITEM_HEADER = "#file onset offset #phone context speaker"


@dataclass
class Part(WriterCommitMessage):
    """What one task wrote: staged files with their final names, and its edges."""

    partition: int
    files: list[tuple[str, str]] = field(default_factory=list)
    first: str | None = None
    last: str | None = None
    tail: str | None = None


def _numbers(row: list) -> str:
    return " ".join("nan" if x is None else repr(float(x)) for x in row)


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.kind = options.get("format", "ark")
        if self.kind not in SUFFIXES:
            raise ValueError(f"format must be one of {sorted(SUFFIXES)}")
        self.options = dict(options)
        self.path = options["path"]
        self.system, self.root = open_path(self.path)
        if self.system.get_file_info(self.root).type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.path} exists")
        self.staging = f"{self.root}/_staging-{uuid.uuid4().hex}"

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "system"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.system, _ = open_path(self.path)

    # --- tasks ---

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        part = Part(TaskContext.get().partitionId())
        folder = f"{self.staging}/{part.partition}-{uuid.uuid4().hex}"
        self.system.create_dir(folder, recursive=True)
        if self.kind in ("ark", "items"):
            self._ordered(iterator, part, folder)
        else:
            self._files(iterator, part, folder)
        return part

    def _lines(self, batch: pa.RecordBatch) -> Iterator[tuple[str | None, str]]:
        """Utterance and line of each row; items have no opening marks."""
        if self.kind == "items":
            for row in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)]):
                yield None, " ".join("" if x is None else str(x) for x in row)
            return
        for utt, feats in zip(batch.column("utt").to_pylist(), batch.column("feats").to_pylist()):
            yield str(utt), _numbers(feats)

    def _ordered(self, batches: Iterator[pa.RecordBatch], part: Part, folder: str) -> None:
        """All lines but the last, which waits for what follows it."""
        name = f"{folder}/body"
        with self.system.open_output_stream(name) as out:
            for batch in batches:
                lines = []
                for utt, line in self._lines(batch):
                    if part.tail is None:
                        part.first = utt
                    else:
                        lines.append(part.tail + self._between(part.last, utt))
                    part.last, part.tail = utt, line
                out.write("".join(lines).encode())
        part.files.append((name, ""))

    @staticmethod
    def _between(before: str | None, after: str | None) -> str:
        return "\n" if before == after else f" ]\n{after} [\n"

    def _files(self, batches: Iterator[pa.RecordBatch], part: Part, folder: str) -> None:
        """One file after the other: rows come sorted by utterance and place."""
        utt, out = None, None
        for batch in batches:
            names = batch.column("utt").to_pylist()
            edges = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                rows = batch.slice(a, b - a)
                if out is None or names[a] != utt:
                    if out is not None:
                        out.close()
                    utt = names[a]
                    base = f"{utt}{SUFFIXES[self.kind]}"
                    if "/" in base or base.startswith((".", "_")):
                        raise ValueError(f"{utt!r} cannot name a file")
                    out = self.system.open_output_stream(f"{folder}/{base}")
                    part.files.append((f"{folder}/{base}", base))
                    out.write(self._header(rows))
                out.write(self._body(rows))
        if out is not None:
            out.close()

    def _header(self, rows: pa.RecordBatch) -> bytes:
        n = rows.column("n")[0].as_py()
        if self.kind == "wav":
            rate, size = int(self.options["rate"]), 2 * n
            if size + 36 >= 1 << 32:
                raise ValueError(f"{rows.column('utt')[0]} is too long for a wav file")
            return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", size + 36, b"WAVE", b"fmt ", 16, 1, 1,
                               rate, 2 * rate, 2, 16, b"data", size)
        width = len(rows.column("feats")[0])
        if self.kind == "npy":
            head = f"{{'descr': '<f8', 'fortran_order': False, 'shape': ({n}, {width}), }}"
            head += " " * (-(len(head) + 11) % 64) + "\n"
            return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(head)) + head.encode()
        names = self.options["channels"].split(",")
        if len(names) != width:
            raise ValueError(f"{len(names)} names for {width} channels")
        lines = ["EST_File Track", "DataType binary", "ByteOrder 01", f"NumFrames {n}",
                 f"NumChannels {width}", *[f"Channel_{i} {c}" for i, c in enumerate(names)]]
        return ("\n".join([*lines, "EST_Header_End"]) + "\n").encode()

    def _body(self, rows: pa.RecordBatch) -> bytes:
        if self.kind == "wav":
            x = rows.column("value").to_numpy(zero_copy_only=False)
            return np.clip(np.rint(x * 32768), -32768, 32767).astype("<i2").tobytes()
        x = rows.column("feats").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        if self.kind == "npy":
            return x.astype("<f8").tobytes()
        ix = rows.column("frame_ix").to_numpy(zero_copy_only=False)
        time = ix / float(self.options["rate"])
        return np.column_stack([time, np.ones(len(x)), x]).astype("<f4").tobytes()

    # --- driver ---

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        try:
            self.system.create_dir(self.root, recursive=True)
            if self.kind in ("ark", "items"):
                self._place_ordered([p for p in parts if p.tail is not None])
            else:
                for part in parts:
                    for staged, name in part.files:
                        self.system.move(staged, f"{self.root}/{name}")
            if self.system.get_file_info(self.staging).type != fs.FileType.NotFound:
                self.system.delete_dir(self.staging)
            self._put("_SUCCESS", "")
        except Exception:
            self.abort(messages)
            raise

    def _place_ordered(self, parts: list[Part]) -> None:
        """Bodies at odd places, what joins them at even ones."""
        before = None
        for i, part in enumerate(parts):
            if before is None:
                joint = f"{ITEM_HEADER}\n" if self.kind == "items" else f"{part.first} [\n"
            else:
                joint = before.tail + self._between(before.last, part.first)
            self._put(self._name(2 * i), joint)
            self.system.move(part.files[0][0], f"{self.root}/{self._name(2 * i + 1)}")
            before = part
        end = "" if before is None else before.tail + ("\n" if self.kind == "items" else " ]\n")
        if before is None and self.kind == "items":
            end = f"{ITEM_HEADER}\n"
        self._put(self._name(2 * len(parts)), end)

    @staticmethod
    def _name(place: int) -> str:
        return f"part-{place:09d}.txt"

    def _put(self, name: str, content: str) -> None:
        with self.system.open_output_stream(f"{self.root}/{name}") as out:
            out.write(content.encode())

    def abort(self, messages: list[Part | None]) -> None:
        if self.system.get_file_info(self.root).type != fs.FileType.NotFound:
            self.system.delete_dir(self.root)


class ArchiveSink(DataSource):
    """``df.write.format("framelark_archive")``; see ``write_archive``."""

    @classmethod
    def name(cls) -> str:
        return "framelark_archive"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("an archive is not overwritten")
        return ArchiveWriter(self.options)


def _write(rows: DataFrame, path: str, kind: str, **options) -> None:
    rows.sparkSession.dataSource.register(ArchiveSink)
    rows.write.format(ArchiveSink.name()).option("format", kind).options(**options).mode(
        "append").save(path)


def write_ark_archive(frames: DataFrame, path: str) -> None:
    """``utt [``, a line of numbers per frame, ``]`` at the end of the last one.

    The files in name order are the archive; every line lies in one file. No
    lengths are needed, so frames are sorted once and written. A null number
    is written as nan.
    """
    rows = frames.select(F.col("utt"), "frame_ix", "feats")
    _write(rows.repartitionByRange("utt", "frame_ix").sortWithinPartitions("utt", "frame_ix").select(
        F.col("utt").cast("string").alias("utt"), F.col("feats").cast("array<double>").alias("feats"),
    ), path, "ark")


def write_item_archive(items: DataFrame, path: str) -> None:
    """A header row, then blank-separated items by utterance and onset."""
    columns = ["utt", "onset", "offset", "phone", "context", "speaker"]
    rows = items.select(*columns).repartitionByRange("utt", "onset", "offset").sortWithinPartitions(
        "utt", "onset", "offset", "phone")
    _write(rows, path, "items")


def _per_utterance(rows: DataFrame) -> DataFrame:
    """Rows of an utterance in one task: a file is written from its start to its end."""
    return with_length(rows).repartition("utt").sortWithinPartitions("utt", "frame_ix")


def write_tracks(frames: DataFrame, path: str, names: list[str], rate: float) -> None:
    """An EST track per utterance (binary, little-endian, 32-bit)."""
    rows = frames.select(F.col("utt").cast("string").alias("utt"), "frame_ix", "feats")
    _write(_per_utterance(rows), path, "est", channels=",".join(names), rate=rate)


def write_arrays(frames: DataFrame, path: str) -> None:
    """An npy array per utterance, frames by channels."""
    rows = frames.select(F.col("utt").cast("string").alias("utt"), "frame_ix", "feats")
    _write(_per_utterance(rows), path, "npy")


def write_recordings(samples: DataFrame, path: str, rate: int) -> None:
    """A 16-bit wav per utterance out of samples ``(utt, frame_ix, value)`` in [-1, 1)."""
    rows = samples.select(F.col("utt").cast("string").alias("utt"), "frame_ix", "value")
    _write(_per_utterance(rows), path, "wav", rate=rate)

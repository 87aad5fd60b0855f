"""Binary recordings read by byte ranges, as a Python data source.

A track, recording or array is a header and records of one size, so any range
of bytes can be decoded by itself: a record belongs to the range that its first
byte lies in, wherever the file is cut. A task reads the header, then the
records of its range in bounded batches; files of any size spread over the
cluster. Short ranges and small files are dealt out many to a task, ranges that
meet as one. The driver only lists names and sizes.

What is not asked for is not made: a schema with fewer columns (``read_ranges``
takes their names) skips the others, ``channels`` decodes those channels only,
and where the session enables ``spark.sql.python.filterPushdown.enabled``, a
filter on ``utt`` drops whole files before they are opened.

Paths are local or URIs of file systems that Arrow opens; ``binary.read_est``
and its neighbours read whole files through Spark's own file systems.
"""

import os
import struct
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition,
)
from pyspark.sql.types import StructType

from framelark.operators.models import list_column
from framelark.operators.signals import BLOCK
from framelark.sources.binary import _pcm

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
RANGE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
#: Opening a file counts as much as reading so many bytes of it.
OPEN_BYTES = 256 << 10
#: Tasks to a core, when there are ranges enough.
TASKS_A_CORE = 4
HEADER_BYTES = 64 << 10
#: No header of these formats comes near this size.
MOST_HEADER_BYTES = 16 << 20

FRAMES = "utt string, frame_ix int, feats array<double>"
SCHEMAS = {
    "est": "utt string, frame_ix int, time double, feats array<double>",
    "npy": FRAMES,
    "wav": "utt string, sr int, block_ix bigint, samples array<double>",
    "sphere": "utt string, sr int, block_ix bigint, samples array<double>",
}
SUFFIXES = {"est": ".ema", "npy": ".npy", "wav": ".wav", "sphere": ".wav"}


@dataclass
class Layout:
    """Records of ``size`` bytes from byte ``start`` on; ``columns`` decodes some
    of them, given their bytes and the number of the first."""

    start: int
    size: int
    n: int
    columns: Callable[[bytes, int, set[str]], dict[str, pa.Array]]
    #: Decodes the whole table by itself, in batches, where records have no size.
    whole: Callable[[set[str]], Iterator[dict[str, pa.Array]]] | None = None


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def list_files(path: str, suffix: str) -> list[tuple[str, int]]:
    """``(path, size)`` of the files below a folder, hidden ones left out."""
    system, root = open_path(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted(
        (f.path, f.size) for f in found
        if f.type == fs.FileType.File and f.path.endswith(suffix)
        and not any(part.startswith(("_", ".")) for part in f.path[len(root):].split("/"))
    )


def stem(path: str) -> str:
    return os.path.splitext(path.rsplit("/", 1)[-1])[0]


# --- headers ------------------------------------------------------------------


def _head(file: pa.NativeFile, mark: bytes) -> bytes:
    """The file up to and with ``mark``."""
    head = b""
    while mark not in head:
        more = file.read(HEADER_BYTES)
        if not more or len(head) > MOST_HEADER_BYTES:
            raise ValueError(f"no {mark!r} in the header")
        head += more
    return head[: head.index(mark) + len(mark)]


def est_header(file: pa.NativeFile) -> tuple[dict[str, str], list[str], int]:
    """Header fields, channel names and the first byte of the table."""
    if file.read(14) != b"EST_File Track":
        raise ValueError("not an EST track file")
    file.seek(0)
    head = _head(file, b"EST_Header_End")
    file.seek(len(head))
    while (byte := file.read(1)) not in (b"\n", b""):
        head += byte
    fields, names = {}, {}
    for line in head.decode("latin-1").split("\n")[1:]:
        key, _, value = line.strip().partition(" ")
        if key.startswith("Channel_"):
            names[int(key[len("Channel_"):])] = value.strip()
        else:
            fields[key] = value.strip()
    return fields, [names[i] for i in sorted(names)], len(head) + 1


def _picked(found: Sequence[str], asked: Sequence[str] | None, utt: str, width: int) -> list[int]:
    if asked is None:
        return list(range(width))
    place = {name.strip(): i for i, name in enumerate(found)}
    missing = sorted(set(asked) - set(place))
    if missing:
        raise ValueError(f"{utt}: no channel {', '.join(missing)}")
    return [place[name] for name in asked]


def _frames(
    utt: str, first: int, data: np.ndarray, wanted: set[str], lead: int, channels: list[int],
) -> dict[str, pa.Array]:
    """Columns of a matrix whose first ``lead`` columns are not features."""
    out = {}
    if "utt" in wanted:
        out["utt"] = pa.repeat(pa.scalar(utt), len(data))
    if "frame_ix" in wanted:
        out["frame_ix"] = pa.array(np.arange(first, first + len(data), dtype=np.int32))
    if "time" in wanted:
        out["time"] = pa.array(data[:, 0].astype(float))
    if "feats" in wanted:
        out["feats"] = list_column(data[:, [lead + c for c in channels]])
    return out


def est_layout(file: pa.NativeFile, size: int, utt: str, options: dict) -> Layout:
    fields, names, start = est_header(file)
    width = int(fields.get("NumChannels", 0))
    n = int(fields.get("NumFrames", 0))
    channels = _picked(names, options.get("channels"), utt, width)
    kind = fields.get("DataType", "binary")
    if kind == "ascii":
        return _ascii_layout(file, utt, start, n, width, channels)
    if kind != "binary":
        raise ValueError(f"{utt}: unknown data type {kind!r}")
    order = {"01": "<", "10": ">"}[fields.get("ByteOrder", "01")]
    record = 4 * (width + 2)
    if (size - start) // 4 * 4 != n * record:
        raise ValueError(
            f"{utt}: expected {n} rows of {width + 2} values, got {(size - start) // 4} values")

    def columns(body: bytes, first: int, wanted: set[str]) -> dict[str, pa.Array]:
        data = np.frombuffer(body, f"{order}f4").reshape(-1, width + 2)
        return _frames(utt, first, data, wanted, 2, channels)

    return Layout(start, record, n, columns)


def _ascii_layout(
    file: pa.NativeFile, utt: str, start: int, n: int, width: int, channels: list[int],
) -> Layout:
    """Numbers have no fixed size: the range of the first byte reads all, in batches."""
    def whole(wanted: set[str]) -> Iterator[dict[str, pa.Array]]:
        file.seek(start)
        rest, row, left = b"", 0, []
        while True:
            more = file.read(BATCH_BYTES)
            text = rest + more
            cut = len(text) if not more else max(text.rfind(b" "), text.rfind(b"\n")) + 1
            rest = text[cut:]
            left += [float(x) for x in text[:cut].split()]
            full = len(left) // (width + 2) * (width + 2)
            if full:
                data = np.array(left[:full]).reshape(-1, width + 2)
                yield _frames(utt, row, data, wanted, 2, channels)
                row, left = row + len(data), left[full:]
            if not more:
                break
        if left or row != n:
            raise ValueError(f"{utt}: expected {n} rows of {width + 2} values, got "
                             f"{row * (width + 2) + len(left)} values")

    return Layout(start, 1, 0, lambda *_: {}, whole)


def npy_layout(file: pa.NativeFile, size: int, utt: str, options: dict) -> Layout:
    version = np.lib.format.read_magic(file)
    read = {1: np.lib.format.read_array_header_1_0, 2: np.lib.format.read_array_header_2_0}
    if version[0] not in read:
        raise ValueError(f"{utt}: npy format {version}")
    shape, by_column, kind = read[version[0]](file)
    if kind.hasobject or (by_column and len(shape) > 1) or not shape:
        raise ValueError(f"{utt}: only arrays of numbers in row order can be read")
    width = int(np.prod(shape[1:], dtype=np.int64))
    start, record = file.tell(), width * kind.itemsize
    if size - start < shape[0] * record:
        raise ValueError(f"{utt}: expected {shape[0]} rows of {record} bytes, got {size - start} bytes")
    channels = options.get("channels")
    picked = list(range(width)) if channels is None else [int(c) for c in channels]
    name = utt.removesuffix(f"_{options['kind']}") if options.get("kind") else utt

    def columns(body: bytes, first: int, wanted: set[str]) -> dict[str, pa.Array]:
        return _frames(name, first, np.frombuffer(body, kind).reshape(-1, width), wanted, 0, picked)

    return Layout(start, max(record, 1), shape[0] if record else 0, columns)


def _audio(
    utt: str, start: int, n_bytes: int, rate: int, width: int, channels: int, order: str, block: int,
) -> Layout:
    """Blocks of samples as records; the last one is shorter."""
    if width not in (1, 2, 3, 4):
        raise ValueError(f"{utt}: samples of {width} bytes")
    each = width * channels
    total = n_bytes // each

    def columns(body: bytes, first: int, wanted: set[str]) -> dict[str, pa.Array]:
        body = body[: (total - first * block) * each]
        x = _pcm(body, width, channels, order)
        bounds = np.append(np.arange(0, len(x), block), len(x)).astype(np.int32)
        n = len(bounds) - 1
        made = {
            "utt": lambda: pa.repeat(pa.scalar(utt), n),
            "sr": lambda: pa.array(np.full(n, rate, np.int32)),
            "block_ix": lambda: pa.array(np.arange(first, first + n, dtype=np.int64)),
            "samples": lambda: pa.ListArray.from_arrays(pa.array(bounds), pa.array(x)),
        }
        return {name: make() for name, make in made.items() if name in wanted}

    return Layout(start, block * each, -(-total // block), columns)


def wav_layout(file: pa.NativeFile, size: int, utt: str, options: dict) -> Layout:
    """Chunks up to the samples; a size of 0 or all ones means: to the end."""
    riff, _, wave = struct.unpack("<4sI4s", file.read(12))
    if riff not in (b"RIFF", b"RF64") or wave != b"WAVE":
        raise ValueError(f"{utt}: not a wav file")
    form, long_size = None, None
    while True:
        head = file.read(8)
        if len(head) < 8:
            raise ValueError(f"{utt}: no samples")
        name, length = struct.unpack("<4sI", head)
        start = file.tell()
        if name == b"data":
            break
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", file.read(16))
        elif name == b"ds64":
            long_size = struct.unpack("<QQ", file.read(16))[1]
        file.seek(start + length + length % 2)
    if form is None or form[0] not in (1, 0xFFFE):
        raise ValueError(f"{utt}: not plain PCM")
    if length in (0, 0xFFFFFFFF):
        length = long_size or size - start
    return _audio(utt, start, min(length, size - start), form[2], form[5] // 8, form[1], "<", options["block"])


def sphere_layout(file: pa.NativeFile, size: int, utt: str, options: dict) -> Layout:
    """An ascii header of stated size, then plain samples."""
    magic, start = (file.read(16).decode("ascii", "replace").split("\n") + [""])[:2]
    if magic != "NIST_1A":
        raise ValueError(f"{utt}: not a SPHERE file")
    fields = {}
    for line in file.read(int(start) - 16).decode("ascii", "replace").split("\n"):
        parts = line.split(" ", 2)
        if parts[0] == "end_head":
            break
        if len(parts) == 3:
            fields[parts[0]] = parts[2]
    coding = fields.get("sample_coding", "pcm")
    if coding != "pcm":
        raise ValueError(f"{utt}: unsupported SPHERE coding {coding}")
    width, channels = int(fields["sample_n_bytes"]), int(fields.get("channel_count", 1))
    order = ">" if fields.get("sample_byte_format", "01") == "10" else "<"
    n_bytes = min(int(fields["sample_count"]) * width * channels, size - int(start))
    return _audio(utt, int(start), n_bytes, int(fields["sample_rate"]), width, channels, order,
                  options["block"])


LAYOUTS = {"est": est_layout, "npy": npy_layout, "wav": wav_layout, "sphere": sphere_layout}


# --- the data source ----------------------------------------------------------


@dataclass
class FileRange(InputPartition):
    path: str
    size: int
    begin: int
    end: int


@dataclass
class Ranges(InputPartition):
    """What one task reads."""

    pieces: list[FileRange]


def dealt(ranges: list[FileRange], tasks: int, most: int = RANGE_BYTES) -> list[Ranges]:
    """Neighbouring ranges together, so that about ``tasks`` remain; a task of more
    than one range has at most ``most`` bytes, files opened counted in."""
    total = sum(r.end - r.begin for r in ranges) + OPEN_BYTES * len({r.path for r in ranges})
    share = min(most, total / max(tasks, 1))
    out: list[Ranges] = []
    full = 0
    for one in ranges:
        last = out[-1].pieces[-1] if out else None
        meets = last is not None and (last.path, last.end) == (one.path, one.begin)
        cost = one.end - one.begin
        if last is None or full + cost + (0 if meets else OPEN_BYTES) > share:
            out.append(Ranges([one]))
            full = cost + OPEN_BYTES
        elif meets:
            out[-1].pieces[-1] = FileRange(one.path, one.size, last.begin, one.end)
            full += cost
        else:
            out[-1].pieces.append(one)
            full += cost + OPEN_BYTES
    return out


class RangeReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.kind = options.get("format", "est")
        if self.kind not in LAYOUTS:
            raise ValueError(f"format must be one of {sorted(LAYOUTS)}")
        self.path = options["path"]
        self.suffix = options.get("suffix", SUFFIXES[self.kind])
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        #: None: each range is a task.
        self.tasks = int(options["tasks"]) if options.get("tasks") else None
        named = options.get("channels")
        self.options = {
            "channels": named.split(",") if named else None, "kind": options.get("kind"),
            "block": int(options.get("block", BLOCK)),
        }
        self.names = schema.fieldNames()
        self.utts: set[str] | None = None

    def _utt(self, path: str) -> str:
        kind = self.options["kind"]
        return stem(path).removesuffix(f"_{kind}") if kind else stem(path)

    def partitions(self) -> Sequence[InputPartition]:
        files = list_files(self.path, self.suffix)
        ranges = [
            FileRange(path, size, begin, min(begin + self.range_bytes, size))
            for path, size in files if self.utts is None or self._utt(path) in self.utts
            for begin in range(0, max(size, 1), self.range_bytes)
        ]
        # Spark reads at least one partition; one of no ranges gives no rows.
        if not ranges:
            return [Ranges([])]
        return [Ranges([r]) for r in ranges] if self.tasks is None else dealt(ranges, self.tasks)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for piece in partition.pieces:
            yield from self._read(piece)

    def _read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        wanted = set(self.names)
        system, _ = open_path(self.path)
        with system.open_input_file(partition.path) as file:
            layout = LAYOUTS[self.kind](file, partition.size, stem(partition.path), self.options)
            if layout.whole is not None:
                for columns in layout.whole(wanted) if partition.begin == 0 else ():
                    yield self._batch(columns)
                return
            first, last = (
                min(layout.n, max(0, -(-(at - layout.start) // layout.size)))
                for at in (partition.begin, partition.end)
            )
            if partition.end >= partition.size:
                last = layout.n
            step = max(1, BATCH_BYTES // layout.size)
            for at in range(first, last, step):
                file.seek(layout.start + at * layout.size)
                body = file.read(min(step, last - at) * layout.size)
                yield self._batch(layout.columns(body, at, wanted))

    def _batch(self, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({c: columns[c] for c in self.names})


class FilteredRangeReader(RangeReader):
    """With filter pushdown, which a session must have enabled for a reader to offer it."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Names of utterances choose files; Spark still checks every filter."""
        for one in filters:
            if isinstance(one, EqualTo) and one.attribute == ("utt",):
                self._only({one.value})
            elif isinstance(one, In) and one.attribute == ("utt",):
                self._only(set(one.value))
            yield one

    def _only(self, names: set) -> None:
        self.utts = names if self.utts is None else self.utts & names


class RangeSource(DataSource):
    """``spark.read.format("framelark_ranges")`` with the options ``path``, ``format``
    (est, npy, wav or sphere), ``suffix``, ``range_bytes``, ``channels``
    (comma-separated names, numbers for npy), ``block`` (samples), ``kind`` (npy:
    names end in ``_<kind>``), ``pushdown`` and ``tasks`` (about so many are made of
    more ranges; without it each range is a task)."""

    @classmethod
    def name(cls) -> str:
        return "framelark_ranges"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("format", "est")]

    def reader(self, schema: StructType) -> DataSourceReader:
        pushes = self.options.get("pushdown", "false") == "true"
        return (FilteredRangeReader if pushes else RangeReader)(self.options, schema)


def read_ranges(
    spark: SparkSession, path: str, kind: str, columns: Sequence[str] | None = None, **options,
) -> DataFrame:
    """Rows of all files of a kind below ``path``; ``columns`` are made, no others."""
    spark.dataSource.register(RangeSource)
    source = spark.read.format(RangeSource.name()).options(
        format=kind, pushdown=spark.conf.get(PUSHDOWN, "false"),
        tasks=TASKS_A_CORE * spark.sparkContext.defaultParallelism, **options)
    if columns is not None:
        kinds = dict(part.strip().split(" ", 1) for part in SCHEMAS[kind].split(","))
        source = source.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return source.load(path)

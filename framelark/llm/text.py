"""Words, word hashes and windows of a batch of texts as flat arrays.

Texts are UTF-8 bytes laid end to end; document d holds bytes
``bounds[d]:bounds[d + 1]``. Arrow batches are cut into slices of some 2 MB
(a longer text is a slice of its own), which bounds a task's memory.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.Generator(np.random.PCG64(20250101))
BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, bounds)`` of consecutive slices; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    wide = pa.large_binary() if pa.types.is_binary(texts.type) else pa.large_string()
    texts = pc.fill_null(texts.cast(wide), b"" if pa.types.is_binary(texts.type) else "")
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield at, end, data[bounds[at]:bounds[end]], bounds[at:end + 1] - bounds[at]
        at = end


def word_spans(data: np.ndarray, bounds: np.ndarray):
    """Starts and ends of the words, and the number of words before each document."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    space = SPACES[data]
    edge = np.ones(n + 1, bool)
    edge[1:n] = space[:-1]
    edge[bounds] = True
    starts = np.flatnonzero(~space & edge[:-1])
    edge[:n] = space
    edge[bounds] = True
    ends = np.flatnonzero(~space & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: int = 0) -> np.ndarray:
    """64-bit hashes of the words, or of their first ``prefix`` bytes."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    size = ends - starts
    if prefix:
        size = np.minimum(size, prefix)
    first = np.cumsum(size) - size
    inside = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
    powers = np.cumprod(np.full(int(size.max()), BASE))
    values = BYTE_VALUES[data[np.repeat(starts, size) + inside]] * powers[inside]
    return mix64(np.add.reduceat(values, first) ^ (size.astype(np.uint64) * BASE))


def windows(hashes: np.ndarray, first: np.ndarray, length: int):
    """Hashes of all ``length``-word windows, their start words and documents."""
    n = len(hashes) - length + 1
    counts = np.maximum(np.diff(first) - length + 1, 0)
    total = int(counts.sum())
    doc = np.repeat(np.arange(len(counts)), counts)
    if total == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), doc
    value = np.zeros(n, np.uint64)
    for j in range(length):
        value = value * BASE + hashes[j:j + n]
    start = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + first[doc]
    return mix64(value[start]), start, doc


def covered(starts: np.ndarray, length: int | np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in a span of ``length`` from one of ``starts``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + length, -1)
    return np.cumsum(steps[:-1]) > 0


def per_document(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of set flags of each document."""
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[bounds])


def repeated_words(hashes: np.ndarray, first: np.ndarray, length: int = 5) -> np.ndarray:
    """Words of each document in windows that it holds twice or more, the first included."""
    value, start, doc = windows(hashes, first, length)
    key = mix64(value ^ mix64(doc.astype(np.uint64) + BASE))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return per_document(covered(start[twice], length, len(hashes)), first)


def repeated_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line of the text."""
    seen, twice = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            twice += bool(line.strip(b" \t\n\r\x0b\x0c"))
        seen.add(line)
    return twice

"""Substring removal by the common-prefix interval tree of a suffix array.

A shard sorts the suffixes of its contents and takes the common prefix of
neighbours: an enhanced suffix array. A stack scan over it finds the intervals
of the prefix tree, each a string and all the places where it occurs. An
interval whose occurrences are not all preceded by the same byte cannot be
extended to the left, nor, by its prefix length, to the right: a maximal
repeat. All occurrences but the first are removed.

Contents reach a shard by anchors (``anchors``), which keep equal windows
together. A long repeat appears as a chain of overlapping pieces, each maximal
within its contents; their union is the whole.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelark.llm.anchors import Bytes, removed, repeated_spans, row_hash
from framelark.llm.common import packed, unpacked
from framelark.llm.text import BASE

WINDOW = 100
SHARD_BYTES = 3 << 20


def suffix_ranks(text: np.ndarray, depth: int) -> dict[int, np.ndarray]:
    """Ranks of all suffixes by 8, 16, .. symbols, until ``depth`` is covered."""
    padded = np.zeros(len(text) + 8, np.uint64)
    padded[:len(text)] = text  # at most 2**8 symbols: 9 bits, seven to a key
    key = np.zeros(len(text), np.uint64)
    for j in range(7):
        key = key << np.uint64(9) | padded[j:j + len(text)]
    rank = np.unique(key, return_inverse=True)[1].astype(np.int32)
    step, ranks = 7, {7: rank}
    while step < depth:
        key = rank.astype(np.int64) * (len(rank) + 2)
        key[:max(0, len(rank) - step)] += rank[step:] + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int32)
        step *= 2
        ranks[step] = rank
    return ranks


def common_prefix(text: np.ndarray, ranks: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray):
    """Equal symbols from places ``a`` and ``b`` on, by ranks and then one by one."""
    found = np.zeros(len(a), np.int64)
    last = len(text) - 1
    for step in sorted(ranks, reverse=True):
        rank = ranks[step]
        x, y = a + found, b + found
        same = (x <= last) & (y <= last)
        same &= rank[np.minimum(x, last)] == rank[np.minimum(y, last)]
        found += step * same
    for _ in range(7):
        x, y = a + found, b + found
        same = (x <= last) & (y <= last)
        same &= (text[np.minimum(x, last)] == text[np.minimum(y, last)]) & (text[np.minimum(x, last)] > 0)
        found += same
    return found


def intervals(prefix: np.ndarray, least: int) -> np.ndarray:
    """``(left, right, length)`` of the prefix tree's intervals of ``least`` or more.

    ``prefix[i]`` is the common prefix of the suffixes i - 1 and i. One stack
    scan; an interval closes where the prefix falls below its length. Places
    where nothing is shared are passed over, pairs on their own need no stack.
    """
    values = np.where(np.append(prefix, 0) >= least, np.append(prefix, 0), 0)
    values[0] = 0
    before, after = np.zeros_like(values), np.zeros_like(values)
    before[1:], after[:-1] = values[:-1], values[1:]
    pairs = np.flatnonzero((values > 0) & (before == 0) & (after == 0))
    out = [np.stack([pairs - 1, pairs, values[pairs]], axis=1)]
    values[pairs] = 0
    before[1:] = values[:-1]
    closed, stack = [], []
    at = np.flatnonzero((values > 0) | (before > 0))
    for i, value in zip(at.tolist(), values[at].tolist()):
        left = i - 1
        while stack and stack[-1][0] > value:
            length, left = stack.pop()
            closed.append((left, i - 1, length))
        if value and (not stack or stack[-1][0] < value):
            stack.append((value, left))
    out.append(np.array(closed, np.int64).reshape(-1, 3))
    return np.concatenate(out)


def repeat_groups(contents: list[bytes], window: int):
    """Maximal repeats of ``window`` bytes or more in the contents.

    ``(interval of each occurrence, content, offset, length)``: occurrences
    of one interval stand together.
    """
    sizes = np.array([len(c) for c in contents])
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8).astype(np.int16) + np.int16(1)
    text[begin + sizes] = 0
    owner = np.repeat(np.arange(len(contents)), sizes + 1)
    left = (begin + sizes)[owner] - np.arange(len(text))  # bytes up to the content's end
    ranks = suffix_ranks(text, int(sizes.max(initial=1)))
    places = np.flatnonzero(left >= window)
    deepest = ranks[max(ranks)]
    suffixes = places[np.argsort(deepest[places], kind="stable")]
    prefix = np.zeros(len(suffixes), np.int64)
    prefix[1:] = np.minimum(
        common_prefix(text, ranks, suffixes[:-1], suffixes[1:]),
        np.minimum(left[suffixes[:-1]], left[suffixes[1:]]))
    found = intervals(prefix, window)
    before = text[np.maximum(suffixes - 1, 0)]  # zero before a content's first byte
    if len(suffixes) and suffixes.min() == 0:
        before[suffixes == 0] = 0
    # Left-extension diversity: another byte before a neighbour, or a start.
    change = np.zeros(len(suffixes) + 1, np.int64)
    change[2:] = np.cumsum((before[1:] != before[:-1]) | (before[1:] == 0))
    diverse = change[found[:, 1] + 1] - change[found[:, 0] + 1] > 0
    found = found[diverse]
    count = found[:, 1] - found[:, 0] + 1
    number = np.repeat(np.arange(len(found)), count)
    rows = np.arange(len(number)) - np.repeat(np.cumsum(count) - count, count) + found[number, 0]
    place = suffixes[rows]
    return number, owner[place], place - begin[owner[place]], found[number, 2]


def with_repeats(contents: list[bytes], unit: Bytes) -> np.ndarray:
    """Numbers of the contents that hold a window found twice in all, by its hash.

    Two windows of one hash keep a content too many, never one too few.
    """
    sizes = np.array([len(c) for c in contents], np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    grams, _, _ = unit.units(np.frombuffer(b"".join(contents), np.uint8), bounds)
    count = np.maximum(sizes - unit.window + 1, 0)
    owner = np.repeat(np.arange(len(contents)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count - bounds[:-1], count)
    value = np.zeros(max(0, int(bounds[-1]) - unit.window + 1), np.uint64)
    for at in [*range(0, unit.window - unit.gram, unit.gram), unit.window - unit.gram]:
        value = value * BASE + grams[at:at + len(value)]  # grams are mixed already
    value = value[place]
    ordered = np.sort(value)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    at = np.searchsorted(twice, value)
    hit = at < len(twice)
    hit[hit] = twice[at[hit]] == value[hit]
    return np.unique(owner[hit])


def earlier_repeats(contents: list[bytes], firsts: np.ndarray, unit: Bytes):
    """Occurrences of maximal repeats that are not the first of their group.

    Contents without a repeated window share no repeat and are not indexed.
    """
    able = with_repeats(contents, unit)
    if len(able) == 0:
        return able, able, able
    number, content, offset, length = repeat_groups([contents[i] for i in able], unit.window)
    content = able[content]
    doc, start = firsts[content, 0], firsts[content, 1] + offset
    order = np.lexsort((start, doc, number))
    number, content, offset, length = (x[order] for x in (number, content, offset, length))
    doc, start = doc[order], start[order]
    first = np.ones(len(number), bool)
    first[1:] = number[1:] != number[:-1]
    head = np.flatnonzero(first)[np.cumsum(first) - 1] if len(first) else first
    later = (doc != doc[head]) | (start != start[head])
    return content[later], offset[later], length[later]


def drop_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, spans, kept)``, one row per document.

    A byte goes if a ``window``-byte string that covers it also starts earlier:
    in a document of a smaller id or before in its own. Strings are judged on
    the input and end with their document. ``spans`` are the maximal byte
    ranges removed, ``kept`` (binary) is the rest. Null text is empty; ids are
    integers, null counts as larger than all; rows of one id are one document
    with several texts at the same places. An empty table gives an empty one.
    """
    spans = repeated_spans(docs, doc_id, text, Bytes(window), earlier_repeats, True, shard_bytes)
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def keep(batches):
        for batch in batches:
            sizes, gone, ranges, kept = [], [], [], []
            for raw, own in zip(unpacked(batch.column(1)), batch.column(2)):
                out = removed(own.values, len(raw))
                edges = np.flatnonzero(np.diff(out, prepend=False, append=False)).tolist()
                inner = [0, *edges, len(raw)]
                sizes.append(len(raw))
                gone.append(int(out.sum()))
                ranges.append([{"start": a, "stop": b} for a, b in zip(edges[::2], edges[1::2])])
                kept.append(b"".join(raw[a:b] for a, b in zip(inner[::2], inner[1::2])))
            pair = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()),
                pa.array(ranges, pa.list_(pair)), pa.array(kept, pa.binary()),
            ], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    ids = F.col(doc_id).alias("doc_id")
    return packed(docs, text, row_hash(doc_id, text), ids).join(spans, "key", "left").select(
        "doc_id", "packed", "spans").mapInArrow(
        keep, f"doc_id {kind}, n_bytes long, n_removed long,"
        " spans array<struct<start: long, stop: long>>, kept binary")

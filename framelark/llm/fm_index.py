"""Substring removal with a compressed FM-index per shard.

A shard indexes its contents: suffixes sorted as deep as a window, the
Burrows-Wheeler transform of the words in a wavelet matrix of packed bits, with
a count of ones per 64 of them. The contents are then streamed from right to
left: a backward-search step adds a word on the left, and once a window is
matched the last word is given up by widening the interval to the suffixes that
share one word less. So every position has the interval of its window, and the
smallest first document in the interval tells whether the match is an earlier
one. Windows found in a smaller document are reported as intervals.

Contents reach a shard by anchors (``anchors``), which keep equal windows
together; a streamed content is indexed in its own shard, so no step fails.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelark.llm.anchors import Words, removed, repeated_spans, row_hash
from framelark.llm.common import packed, unpacked
from framelark.llm.text import word_hashes, word_spans

WINDOW = 13
SHARD_BYTES = 4 << 20


def deeper(ranks: dict[int, np.ndarray], depth: int) -> np.ndarray:
    """Ranks of all suffixes by their first ``depth`` symbols, from shallower ones."""
    if depth not in ranks:
        half = 1 << (depth - 1).bit_length() - 1
        left = deeper(ranks, half)
        right = np.zeros(len(left), np.int64)
        right[:len(left) - (depth - half)] = left[depth - half:] + 1
        key = left * (int(left.max(initial=0)) + 2) + right
        ranks[depth] = np.unique(key, return_inverse=True)[1]
    return ranks[depth]


class WaveletMatrix:
    """Counts of a symbol before a position, on packed bits."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = []
        for shift in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            bits = (values >> shift & 1).astype(bool)
            raw = np.packbits(bits, bitorder="little")
            words = np.zeros(len(values) // 64 + 1, np.uint64)
            words.view(np.uint8)[:len(raw)] = raw
            ones = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=ones[1:])
            self.levels.append((shift, words, ones, len(values) - int(bits.sum())))
            values = np.concatenate([values[~bits], values[bits]])
        self.origin = self.descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, words, ones, zeros in self.levels:
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            rank = ones[word] + np.bitwise_count(words[word] & mask)
            at = np.where(symbol >> shift & 1, zeros + rank, at - rank)
        return at

    def count(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.descend(symbol, at) - self.origin[symbol]


class FMIndex:
    """Of a text of small integers; suffixes are sorted by ``depth`` symbols."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int):
        ranks = {1: text}
        full, less = deeper(ranks, depth), deeper(ranks, depth - 1)
        self.suffixes = np.argsort(full, kind="stable")
        self.transform = WaveletMatrix(text[self.suffixes - 1], symbols)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.group = full[self.suffixes]  # equal for equal windows, ascending
        wide = less[self.suffixes]
        edges = np.flatnonzero(np.concatenate(([True], wide[1:] != wide[:-1])))
        index = np.cumsum(np.concatenate(([True], wide[1:] != wide[:-1]))) - 1
        self.wide_start = edges[index]
        self.wide_end = np.append(edges[1:], len(text))[index]

    def windows(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray, depth: int):
        """For each stretch ``begin:end`` of the text, streamed from its end: the
        places of its windows and the first row of each one's interval."""
        order = np.argsort(begin - end)  # longest first
        begin, end = begin[order], end[order]
        length = end - begin
        lo = np.zeros(len(begin), np.int64)
        hi = np.full(len(begin), len(text), np.int64)
        places, rows = [], []
        for step in range(int(length[0]) if len(length) else 0):
            active = int(np.searchsorted(-length, -step, "left"))
            lo, hi = lo[:active], hi[:active]
            if step >= depth:
                lo, hi = self.wide_start[lo], self.wide_end[lo]
            place = end[:active] - 1 - step
            symbol = text[place]
            lo = self.before[symbol] + self.transform.count(symbol, lo)
            hi = self.before[symbol] + self.transform.count(symbol, hi)
            if step >= depth - 1:
                places.append(place)
                rows.append(lo)
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), np.concatenate(rows)


def earlier_windows(contents: list[bytes], firsts: np.ndarray, unit: Words):
    """Intervals of contents whose windows occur in one of a smaller document."""
    depth = unit.window
    bounds = np.cumsum([0] + [len(c) + 1 for c in contents])
    data = np.frombuffer(b"\n".join(contents) + b"\n", np.uint8)
    starts, ends, first = word_spans(data, bounds)
    word = np.unique(word_hashes(data, starts, ends), return_inverse=True)[1] + 1
    owner = np.repeat(np.arange(len(contents)), np.diff(first))
    place = np.arange(len(word)) + owner  # a zero after each content
    text = np.zeros(len(word) + len(contents), np.int64)
    text[place] = word
    index = FMIndex(text, int(word.max(initial=0)) + 1, depth)
    begin = first[:-1] + np.arange(len(contents))
    places, rows = index.windows(text, begin, begin + np.diff(first), depth)
    # The smallest first document in the interval of each window.
    content = np.zeros(len(text), np.int64)
    content[place] = owner
    doc = np.full(len(text), np.iinfo(np.int64).max)
    doc[place] = firsts[owner, 0]
    edges = np.flatnonzero(np.concatenate(([True], index.group[1:] != index.group[:-1])))
    least = np.minimum.reduceat(doc[index.suffixes], edges)
    number = index.group[rows] - index.group[0]
    hit = np.sort(places[least[number] < doc[places]])
    # Windows that start one after another are one interval.
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (content[hit[1:]] != content[hit[:-1]])
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(hit)))
    owner = content[hit[at]]
    return owner, hit[at] - begin[owner], run + depth - 1


def drop_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``(doc_id, n_words, n_removed, spans, kept)``, one row per document.

    A word goes if a ``window`` of words that covers it also starts in a document
    of a smaller id; windows are judged on the input. ``spans`` are the word
    ranges removed, ``kept`` the other words joined by one space. Null text has
    no words; ids are integers, null counts as larger than all; rows of one id
    are no smaller than each other. An empty table gives an empty one.
    """
    unit = Words(window, min(7, window))
    spans = repeated_spans(docs, doc_id, text, unit, earlier_windows, False, shard_bytes)
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def keep(batches):
        for batch in batches:
            counts, gone, ranges, kept = [], [], [], []
            for raw, own in zip(unpacked(batch.column(1)), batch.column(2)):
                words = raw.split()
                out = removed(own.values, len(words))
                edges = np.flatnonzero(np.diff(out, prepend=False, append=False)).tolist()
                counts.append(len(words))
                gone.append(int(out.sum()))
                ranges.append([{"start": a, "stop": b} for a, b in zip(edges[::2], edges[1::2])])
                kept.append(b" ".join(words if not edges else [words[i] for i in np.flatnonzero(~out)]))
            pair = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()),
                pa.array(ranges, pa.list_(pair)), pa.array(kept, pa.binary()).cast(pa.string()),
            ], names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    ids = F.col(doc_id).alias("doc_id")
    return packed(docs, text, row_hash(doc_id, text), ids).join(spans, "key", "left").select(
        "doc_id", "packed", "spans").mapInArrow(
        keep, f"doc_id {kind}, n_words long, n_removed long,"
        " spans array<struct<start: long, stop: long>>, kept string")

"""Routing of repeated windows to small shards.

A window is a fixed number of units (words or bytes) of one text. Its anchor is
the smallest gram hash in it, so equal windows have equal anchors. Consecutive
windows of one anchor form a piece of text; all places where a window occurs
meet when pieces are grouped by anchor. The steps:

1. Texts emit their anchors; those that occur once cannot repeat and are gone.
2. Texts with recurring anchors emit the pieces around them, once per distinct
   content: a content knows its first occurrence, and its further occurrences
   repeat it as a whole whatever its neighbours are.
3. Distinct contents are dealt to shards of a bounded number of bytes by anchor.
   A shard reports the spans of a content that occur earlier in another one.
   An anchor with more content than a shard holds goes window by window: equal
   windows are one row with their first place before they are looked up, so a
   window of any number of contents is never gathered in one task.
4. Spans go back to the occurrences and are gathered per document.
"""

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelark.llm.common import packed, staged, unpacked
from framelark.llm.text import BASE, covered, mix64, slices, word_hashes, word_spans

LAST = 2**63 - 1
SLICE = 1 << 20
#: Windows in more contents than this, of which there are at most
#: ``COMMON_KEYS``, find their first place in a broadcast table.
COMMON = 20_000
COMMON_KEYS = 100_000
#: Bytes that a shard indexes at once, unless one anchor has more.
INDEXED = 1 << 20
#: More than the units of any content.
FAR = 1 << 32
LISTED = "id long, listed array<struct<offset: bigint, length: bigint>>"


class Words:
    """Units are words; equal texts are equal word sequences."""

    def __init__(self, window: int, gram: int, longest: int = 64):
        self.window, self.gram, self.longest = window, gram, longest

    def units(self, data, bounds):
        starts, ends, first = word_spans(data, bounds)
        values = word_hashes(data, starts, ends)
        grams = np.zeros(max(0, len(values) - self.gram + 1), np.uint64)
        for j in range(self.gram):
            grams = grams * BASE + values[j:j + len(grams)]
        return mix64(grams), first, (starts, ends)

    def content(self, raw, places, a, b):
        starts, ends = places
        return b" ".join(raw[starts[a]:ends[b - 1]].split())

    def windows(self, contents):
        """``(id, window, doc, start, at)`` of all windows of the contents."""
        width = self.window

        def each(batches):
            for batch in (b.slice(at, 128) for b in batches for at in range(0, b.num_rows, 128)):
                ids, doc, start = (batch.column(i).to_pylist() for i in (0, 2, 3))
                out = [[] for _ in range(5)]
                for i, raw in enumerate(batch.column(1).to_pylist()):
                    words = raw.split()
                    for at in range(len(words) - width + 1):
                        part = b" ".join(words[at:at + width])
                        for to, v in zip(out, (ids[i], part, doc[i], start[i] + at, at)):
                            to.append(v)
                yield pa.RecordBatch.from_arrays([
                    pa.array(v, t) for v, t in zip(out, (
                        pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))
                ], names=["id", "window", "doc", "start", "at"])

        return contents.select("id", "content", "doc", "start").mapInArrow(
            each, "id long, window binary, doc long, start long, at long")


class Bytes:
    """Units are bytes; a gram is 24 of them."""

    def __init__(self, window: int, longest: int = 124):
        self.window, self.gram, self.longest = window, 24, longest

    def units(self, data, bounds):
        n = max(0, len(data) - self.gram + 1)
        if n == 0:
            return np.zeros(0, np.uint64), bounds, None
        data = np.ascontiguousarray(data)
        grams = np.zeros(n, np.uint64)
        for j in (0, 8, 16):
            load = np.ndarray((n,), "<u8", data, j, (1,))
            grams = (grams ^ (grams >> np.uint64(29))) * BASE + load
        return mix64(grams), bounds, None

    def content(self, raw, places, a, b):
        return raw[a:b]

    def windows(self, contents):
        """``(id, window, doc, start, at)`` of all windows of the contents."""
        places = F.sequence(F.lit(0), F.length("content") - self.window)
        return contents.select("id", "content", "doc", "start", F.explode(places).alias("at")).select(
            "id", F.col("content").substr(F.col("at") + 1, F.lit(self.window)).alias("window"),
            "doc", (F.col("start") + F.col("at")).alias("start"), F.col("at").cast("long").alias("at"))


def sliding(best: Callable, values: np.ndarray, width: int) -> np.ndarray:
    """``best`` (minimum or maximum) over every ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        values, size = best(values[:-size], values[size:]), 2 * size
    return best(values[:len(values) - width + size], values[width - size:]) if size < width else values


def pieces(unit, data, bounds, count: bool = False):
    """``(document, first window, end of windows, anchor, grams, places)`` of all pieces.

    ``grams`` (with ``count``, else ones) counts where the piece has its anchor's
    gram: a window that repeats within its piece shows as a gram that does.
    """
    grams, first, places = unit.units(data, bounds)
    width = unit.window - unit.gram + 1
    none = np.zeros(0, np.int64)
    if len(grams) < width:
        return none, none, none, np.zeros(0, np.uint64), none, places
    least = sliding(np.minimum, grams, width)
    total = first[-1]
    short = np.maximum(first[1:] - unit.window + 1, first[:-1])
    steps = np.zeros(total + 1, np.int32)
    np.add.at(steps, short, 1)
    np.add.at(steps, first[1:], -1)
    valid = np.cumsum(steps)[:len(least)] == 0
    edge = np.ones(len(least) + 1, bool)
    edge[1:-1] = (least[1:] != least[:-1]) | ~valid[1:] | ~valid[:-1]
    start = np.flatnonzero(valid & edge[:-1])
    stop = np.flatnonzero(valid & edge[1:]) + 1
    repeats = np.ones(len(start), np.int64)
    if count and len(start):
        pad = np.zeros(width - 1, np.uint64)
        widest = sliding(np.maximum, np.concatenate(
            [pad, np.where(valid, least, np.uint64(0)), pad]), width)
        at = np.flatnonzero(widest == grams)
        owner = np.searchsorted(start, at, "right") - 1
        off = np.flatnonzero(least[start[owner]] != grams[at])
        while len(off):  # a later piece began before the gram was passed
            owner[off] -= 1
            off = off[least[start[owner[off]]] != grams[at[off]]]
        repeats = np.bincount(owner, minlength=len(start))
    cuts = -(-(stop - start) // unit.longest)
    index = np.repeat(np.arange(len(start)), cuts)
    inner = np.arange(len(index)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    begin = start[index] + inner * unit.longest
    doc = np.searchsorted(first, begin, "right") - 1
    return doc, begin, np.minimum(begin + unit.longest, stop[index]), least[begin], repeats[index], places


def row_hash(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.lit(1), F.col(doc_id).cast("long"), F.col(text))


def doc_order(doc_id: str) -> Column:
    """Documents by id; null comes last."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))


def listed_spans(ids: pa.ChunkedArray, number, offset, length) -> pa.Table:
    """``(id, listed)``: spans of each content, those that overlap or touch as one."""
    begin = number.astype(np.int64) * FAR + offset
    order = np.argsort(begin, kind="stable")
    begin = begin[order]
    end = np.maximum.accumulate(begin + length[order]) if len(begin) else begin
    head = np.flatnonzero(np.append(True, begin[1:] > end[:-1])[:len(begin)])
    begin, end = begin[head], end[np.append(head[1:], len(begin))[:len(head)] - 1]
    owner = begin // FAR
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[:len(owner)])
    spans = pa.StructArray.from_arrays(
        [pa.array(begin - owner * FAR), pa.array(end - begin)], ["offset", "length"])
    return pa.table({
        "id": ids.take(pa.array(owner[first])),
        "listed": pa.ListArray.from_arrays(
            pa.array(np.append(first, len(owner)).astype(np.int32)), spans)})


def later_windows(contents: DataFrame, unit, same_document: bool) -> DataFrame:
    """``(id, listed)``: spans of the windows of contents that occur earlier.

    A window is known by two hashes. The first place of each is found with
    partial aggregation and joined back: by broadcast for the few common
    windows, so that none of them has its rows in one task.
    """
    place = F.col("doc")
    if same_document:  # one number per place, in their order
        place = place.cast("decimal(20,0)") * F.lit(Decimal(10**12)) + F.col("start")
    both = ["h1", "h2"]
    windows = unit.windows(contents).select(
        "id", "at", F.xxhash64(F.lit(1), "window").alias("h1"),
        F.xxhash64(F.lit(2), "window").alias("h2"), place.alias("place"))
    firsts = staged(windows.groupBy(*both).agg(
        F.min("place").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1"))
    total = firsts.agg(F.sum("m").alias("m")).first()["m"] or 0
    many = F.col("m") > max(COMMON, total // COMMON_KEYS)
    common = F.broadcast(firsts.where(many).drop("m"))
    rest = windows.join(common, both, "left_anti").join(firsts.where(~many).drop("m"), both)
    later = windows.join(common, both).unionByName(rest).where("place > first").groupBy("id").agg(
        F.array_sort(F.collect_list("at")).alias("at"))
    at, width = F.col("at"), F.lit(unit.window).cast("long")
    heads = F.filter(at, lambda x, i: (i == 0) | (x > F.get(at, i - 1) + width))
    tails = F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) > x + width))
    return later.select("id", F.zip_with(heads, tails, lambda a, b: F.struct(
        a.alias("offset"), (b - a + width).alias("length"))).alias("listed"))


def repeated_spans(
    docs: DataFrame, doc_id: str, text: str, unit, shard: Callable, same_document: bool,
    shard_bytes: int,
) -> DataFrame:
    """``(key, spans)``: units of each row that a repeated window covers.

    ``shard(contents, firsts, unit) -> (content, offset, length)`` arrays names
    the spans of contents that occur in another content with an earlier first
    occurrence. With ``same_document`` an earlier place in the same document
    counts, else only a smaller document.
    """
    def anchors(batches):
        for batch in batches:
            docs_ = batch.column(0).to_numpy()
            for at, end, data, bounds in slices(batch.column(1), SLICE):
                doc, begin, stop, anchor, grams, _ = pieces(unit, data, bounds, same_document)
                seen = np.lexsort((doc, anchor))
                anchor, doc, grams = anchor[seen], doc[seen], grams[seen]
                new = np.ones(len(seen), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                count = np.ones(len(first), np.int64)
                if same_document and len(first):
                    count = np.minimum(np.add.reduceat(np.maximum(grams, 1), first), 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[new].view(np.int64)), pa.array(docs_[at:end][doc[new]]),
                     pa.array(count)], names=["anchor", "doc", "n"])

    recurring = docs.select(doc_order(doc_id).alias("doc"), F.col(text).alias("_text")).mapInArrow(
        anchors, "anchor long, doc long, n long"
    ).withColumn("all", F.sum("n").over(Window.partitionBy("anchor"))).where("all > 1")
    wanted = recurring.groupBy("doc").agg(F.collect_list("anchor").alias("anchors"))

    def cut(batches):
        """Pieces of the recurring anchors of each text, some texts at a time."""
        for batch in batches:
            raw = unpacked(batch.column(2))
            ends = np.cumsum([len(r) for r in raw])
            at = 0
            while at < len(raw):
                done = ends[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(ends, done + SLICE, "right")))
                part, bounds = b"".join(raw[at:end]), np.append(0, ends[at:end] - done)
                doc, begin, stop, anchor, _, places = pieces(unit, np.frombuffer(part, np.uint8), bounds)
                lists = batch.column(3).slice(at, end - at)
                known = lists.flatten().to_numpy().view(np.uint64)
                owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
                # The anchors as small numbers, so that one with its text is a number too.
                values, number = np.unique(np.concatenate([known, anchor]), return_inverse=True)
                pair = np.concatenate([owner, doc]) * len(values) + number
                keep = np.flatnonzero(np.isin(pair[len(known):], pair[:len(known)]))
                doc, begin, stop = doc[keep], begin[keep], stop[keep] + unit.window - 1
                first = bounds if places is None else np.searchsorted(places[0], bounds)
                rows = pa.array(at + doc)
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchor[keep].view(np.int64)),
                    pa.array([unit.content(part, places, a, b) for a, b in zip(begin, stop)], pa.binary()),
                    batch.column(0).take(rows), batch.column(1).take(rows),
                    pa.array(begin - first[doc]), pa.array(stop - begin),
                ], names=["anchor", "content", "key", "doc", "start", "size"])
                at = end

    def joined(batches):
        """Small batches go on as one."""
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 5_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    texts = packed(docs, text, row_hash(doc_id, text), doc_order(doc_id).alias("doc"))
    found = staged(texts.join(wanted, "doc").select("key", "doc", "packed", "anchors").mapInArrow(
        lambda batches: joined(cut(batches)),
        "anchor long, content binary, key long, doc long, start long, size long",
    ).select(F.xxhash64("content").alias("c"), "anchor", "content", "key", "doc", "start", "size"))
    contents = staged(found.groupBy("anchor", "c").agg(
        F.first("content").alias("content"),
        F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("n"),
    ).select(
        F.monotonically_increasing_id().alias("id"), "anchor", "c", "content",
        "first.doc", "first.start", "n"))

    weight = F.sum(F.length("content"))
    weights = contents.groupBy("anchor").agg(weight.alias("bytes"), F.count(F.lit(1)).alias("n"))
    total = contents.agg(weight.alias("b")).first()["b"] or 0
    hot = staged(weights.where(F.col("bytes") > shard_bytes).select("anchor", "bytes"))
    shards = max(1, -(-total // shard_bytes))

    dealt = contents.join(hot, "anchor", "left_anti").select(
        "id", "anchor", "content", "doc", "start",
        F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))

    def search(table):
        """Anchor by anchor, or some small ones at once: they share no window."""
        table = table.sort_by("anchor")
        anchor = table.column("anchor").to_numpy()
        ends = np.cumsum(pc.binary_length(table.column("content")).to_numpy().astype(np.int64))
        edges = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor))
        found, at = [], 0
        while at < len(anchor):
            done = ends[at - 1] if at else 0
            fits = edges[(edges > at) & (ends[edges - 1] <= done + INDEXED)]
            to = int(fits[-1]) if len(fits) else int(edges[np.searchsorted(edges, at, "right")])
            part = table.slice(at, to - at)
            firsts = np.stack([part.column(n).to_numpy() for n in ("doc", "start")], axis=1)
            number, offset, length = shard(part.column("content").to_pylist(), firsts, unit)
            found.append(listed_spans(part.column("id"), number, offset, length))
            at = to
        return pa.concat_tables(found)

    listed = staged(dealt.groupBy("shard").applyInArrow(search, LISTED).unionByName(later_windows(
        contents.join(hot.select("anchor"), "anchor"), unit, same_document)))

    # Contents that cover anything; their places get the spans in one join.
    marked = contents.select(
        "id", "anchor", "c", F.col("doc").alias("d"), F.col("start").alias("s"), "n",
    ).join(listed, "id", "left").where("n > 1 or listed is not null").drop("id", "n")
    places = found.select("anchor", "c", "key", "doc", "start", "size").join(
        marked, ["anchor", "c"])
    own = F.col("doc") == F.col("d")
    if same_document:
        own = own & (F.col("start") == F.col("s"))
    nothing = F.array().cast("array<struct<offset: bigint, length: bigint>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("offset"), F.col("size").alias("length")))
    spans = places.select("key", "start", F.explode(
        F.when(~own, whole).otherwise(F.coalesce("listed", nothing))).alias("p")).select(
        "key", (F.col("start") + F.col("p.offset")).alias("start"),
        (F.col("start") + F.col("p.offset") + F.col("p.length")).alias("stop"))
    return staged(spans.groupBy("key").agg(
        F.collect_set(F.struct("start", "stop")).alias("spans")))


def removed(spans, n: int) -> np.ndarray:
    """Flags of the units that a document's spans cover."""
    if spans is None or len(spans) == 0:
        return np.zeros(n, bool)
    start = spans.field("start").to_numpy()
    return covered(start, spans.field("stop").to_numpy() - start, n)

"""Phone labels: intervals, voicing, silence trimming, items, triphones.

Labels are rows ``(utt, phone_ix, t_end, symbol)`` in time order, ``phone_ix``
running from 0. A phone starts where the one before it ends.
"""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelark.functions import kernels
from framelark.functions.scalars import end_frame, nearest_frame, round_exact, start_frame
from framelark.operators.frames import (
    by_segment, core_only, dimension_join, lengths, number_rows, running_total, salted_join,
    segment_window, segmented,
)
from framelark.session import shuffles_dropped

SILENCE = "#"


def neighbours(
    phones: DataFrame, columns: dict[str, Column], margin: int,
    segment: int | None = None,
) -> DataFrame:
    """Add columns computed over phones at most ``margin`` places away."""
    rows = segmented(phones, margin, "phone_ix", segment).withColumns(columns)
    return core_only(rows, "phone_ix", segment)


def _window():
    return segment_window(ix="phone_ix")


def intervals(phones: DataFrame, segment: int | None = None) -> DataFrame:
    """Add ``t_start``."""
    start = F.lag("t_end", 1, 0.0).over(_window())
    return neighbours(phones, {"t_start": start}, 1, segment)


def map_symbols(
    phones: DataFrame, chart: DataFrame, target: str, key: str = "symbol"
) -> DataFrame:
    """Replace symbols by the chart's ``target``; an unknown one fails the job."""
    table = chart.where(F.col(key).isNotNull()).select(
        F.col(key).alias("symbol"), F.col(target).alias("_new")
    )
    missing = F.raise_error(F.concat(F.lit("symbol not in the chart: "), F.col("symbol")))
    return (
        dimension_join(phones, table.withColumn("_known", F.lit(True)), ["symbol"], "left")
        .withColumn("symbol", F.when(F.col("_known"), F.col("_new")).otherwise(missing))
        .drop("_new", "_known")
    )


def map_symbols_or_null(rows: DataFrame, chart: DataFrame, column: str,
                        source: str, target: str) -> DataFrame:
    """Replace the symbols of ``column``; an unknown one becomes NULL."""
    table = chart.select(F.col(source).alias(column), F.col(target).alias("_new"))
    joined = dimension_join(rows, table, [column], "left")
    return joined.withColumn(column, F.col("_new")).drop("_new")


def voicing(
    phones: DataFrame, chart: DataFrame, sampling_rate: float, key: str = "symbol",
    segment: int | None = None,
) -> DataFrame:
    """Theoretical voicing ``(utt, frame_ix, voiced)`` on the frame grid.

    Phones tile the time line, so each writes out its own frames and no range
    join is needed; the last one goes on, unvoiced, to the end of the grid.
    """
    w = _window()
    rows = neighbours(
        map_symbols(
            phones.select("utt", "phone_ix", "t_end", "symbol"), chart, "voiced", key
        ),
        {
            "_t_start": F.lag("t_end", 1, 0.0).over(w),
            "_is_last": F.lead("phone_ix", 1).over(w).isNull(),
        },
        1, segment,
    )
    first = nearest_frame(F.col("_t_start"), sampling_rate)
    stop = nearest_frame(F.col("t_end"), sampling_rate)
    rows = rows.select(
        "utt", F.col("symbol").alias("_voiced"), first.alias("_first"),
        stop.alias("_stop"),
        F.when(F.col("_is_last"), end_frame(F.col("t_end"), sampling_rate))
        .otherwise(stop).alias("_grid"),
    ).where(F.col("_grid") > F.col("_first"))
    frame = F.explode(F.sequence(F.col("_first"), F.col("_grid") - 1)).alias("frame_ix")
    flag = F.when(
        (F.col("frame_ix") < F.col("_stop")) & (F.col("_voiced") != 0), 1.0
    ).otherwise(0.0)
    return rows.select("utt", "_voiced", "_stop", frame).select(
        "utt", "frame_ix", flag.alias("voiced")
    )


def boundaries(
    phones: DataFrame, sampling_rate: float, segment: int | None = None
) -> DataFrame:
    """Frames between the edge silences: ``(utt, start_ix, end_ix)``."""
    rows = intervals(phones.select("utt", "phone_ix", "t_end", "symbol"), segment)
    ends = rows.groupBy("utt").agg(
        F.min_by(F.struct("symbol", "t_end"), "phone_ix").alias("head"),
        F.max_by(F.struct("symbol", "t_start", "t_end"), "phone_ix").alias("tail"),
    )
    start = F.when(F.col("head.symbol") == SILENCE, F.col("head.t_end")).otherwise(0.0)
    end = F.when(
        F.col("tail.symbol") == SILENCE, F.col("tail.t_start")
    ).otherwise(F.col("tail.t_end"))
    return ends.select(
        "utt", start_frame(start, sampling_rate).alias("start_ix"),
        end_frame(end, sampling_rate).alias("end_ix"),
    )


def common_bounds(kinds: dict[str, DataFrame], bounds: DataFrame) -> DataFrame:
    """Cut the bounds to the shortest kind; a kind that ends before the start
    of the speech fails the job."""
    sizes = None
    for name, frames in kinds.items():
        part = lengths(frames).select("utt", F.lit(name).alias("kind"), "n")
        sizes = part if sizes is None else sizes.unionByName(part)
    # A kind without any frame of an utterance has length 0 there.
    shortest = sizes.groupBy("utt").agg(
        F.min_by(F.struct("kind", "n"), "n").alias("least"),
        F.count(F.lit(1)).alias("n_kinds"),
    )
    joined = bounds.join(shortest, "utt")
    too_short = (F.col("least.n") < F.col("start_ix")) | (F.col("n_kinds") < len(kinds))
    message = F.concat(
        F.lit("features end before the speech starts: "), F.col("utt").cast("string"),
        F.lit(" "), F.col("least.kind"),
    )
    end = F.when(too_short, F.raise_error(message).cast("int")).otherwise(
        F.least(F.col("end_ix"), F.col("least.n"))
    )
    return joined.select("utt", "start_ix", end.alias("end_ix"))


def trim(frames: DataFrame, bounds: DataFrame) -> DataFrame:
    """Keep frames in [start_ix, end_ix) and renumber from 0."""
    return (
        salted_join(frames, bounds, ["utt"])
        .where((F.col("frame_ix") >= F.col("start_ix")) & (F.col("frame_ix") < F.col("end_ix")))
        .withColumn("frame_ix", F.col("frame_ix") - F.col("start_ix"))
        .drop("start_ix", "end_ix")
    )


def items(
    phones: DataFrame, offset: str = "trim", segment: int | None = None
) -> DataFrame:
    """Inner phones with their context, one row per token to discriminate.

    Times count from where trimming starts, so that they fit the trimmed
    features; ``offset='first_label'`` counts from the first label's end even
    when that label is speech.
    """
    if offset not in ("trim", "first_label"):
        raise ValueError("offset must be 'trim' or 'first_label'")
    w = _window()
    rows = neighbours(
        phones,
        {
            "t_start": F.lag("t_end", 1, 0.0).over(w),
            "_prev": F.lag("symbol", 1).over(w),
            "_next": F.lead("symbol", 1).over(w),
        },
        1, segment,
    )
    head = phones.groupBy("utt").agg(
        F.min_by(F.struct("symbol", "t_end"), "phone_ix").alias("head")
    )
    zero = F.col("head.t_end")
    if offset == "trim":
        zero = F.when(F.col("head.symbol") == SILENCE, zero).otherwise(0.0)
    inner = rows.where(F.col("_prev").isNotNull() & F.col("_next").isNotNull())
    inner = salted_join(inner, head, ["utt"], spread=F.col("phone_ix"))
    return inner.select(
        "utt", "phone_ix",
        round_exact(F.col("t_start") - zero, 3).alias("onset"),
        round_exact(F.col("t_end") - zero, 3).alias("offset"),
        F.col("symbol").alias("phone"),
        F.concat_ws("_", "_prev", "_next").alias("context"),
        "speaker",
    )


def triphones(phones: DataFrame, segment: int | None = None) -> DataFrame:
    """Distinct ``(utt, triphone)``."""
    w = _window()
    rows = neighbours(
        phones.select("utt", "phone_ix", "symbol"),
        {"_b": F.lead("symbol", 1).over(w), "_c": F.lead("symbol", 2).over(w)},
        2, segment,
    )
    return (
        rows.where(F.col("_c").isNotNull())
        .select("utt", F.concat_ws("_", "symbol", "_b", "_c").alias("triphone"))
        .distinct()
    )


def token_triphones(texts: DataFrame, joiner: str = "_") -> DataFrame:
    """Distinct ``(utt, triphone)`` of rows ``(utt, tokens ARRAY<STRING>)``.

    Each row is worked on by itself. The outer ``transform`` binds the tokens,
    so that the expression they come from is evaluated once per row.
    """
    def joined(a: Column, b: Column) -> Column:
        return F.concat(a, F.lit(joiner), b)

    def grams(tokens: Column) -> Column:
        n = F.greatest(F.size(tokens) - 2, F.lit(0))
        pairs = F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), joined)
        return F.array_distinct(F.zip_with(pairs, F.slice(tokens, F.lit(3), n), joined))

    each = F.flatten(F.transform(F.array("tokens"), grams))
    return texts.select("utt", F.explode(each).alias("triphone"))


#: Bytes of text that a task cuts up at once, unless one text has more.
SLICE_BYTES = 4 << 20
#: Bits of a hash that number its place in the table of recurring ones (8 MB).
PLACE_BITS = 26


def _text_slices(batch: pa.RecordBatch, separators: str):
    """``(utts, rows, data, offsets)`` of a batch ``(utt, text)`` in bounded parts.

    Token i is ``data[offsets[i]:offsets[i + 1]]`` and lies in row ``rows[i]`` of ``utts``.
    """
    utts = batch.column(0)
    texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    splits = np.zeros(256, bool)
    splits[list(separators.encode())] = True
    at = 0
    while at < len(utts):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE_BYTES, "right")) - 1)
        part, edges = data[bounds[at]:bounds[end]], bounds[at:end + 1] - bounds[at]
        inside = ~splits[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[0] = True
        edge[1:-1] = ~inside[:-1]
        edge[edges] = True
        starts = np.flatnonzero(inside & edge[:-1])
        before = np.concatenate(([0], np.cumsum(inside)))
        yield (utts.slice(at, end - at), np.searchsorted(edges, starts, "right") - 1,
               part[inside], np.append(before[starts], before[-1]))
        at = end


def recurring_triphones(
    texts: DataFrame, limit: int, joiner: str = "_", separators: str = " \t\n\r",
) -> DataFrame:
    """``token_triphones`` of rows ``(utt, text)``, less what cannot reach ``limit``.

    Tokens are what lies between ASCII ``separators``. Every triphone found in
    ``limit`` rows is kept with all its rows; of the others some may be. Hashes
    are counted first: four bytes instead of a string go through the shuffle,
    many to a row, and only triphones at a place that a recurring hash takes are
    written out as strings. A hash that two triphones share, or a triphone that repeats
    within a row, only keeps more of them.
    """
    rows = texts.select("utt", "text")

    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    # So many leading bits number a range; the next 32 stand for the hash in it.
    bits = max(6, int(size // SLICE_BYTES).bit_length() - 1)

    def dealt(batches):
        """The hashes of a slice, each ``limit`` times at most, by range of hashes."""
        for batch in batches:
            for _, row, data, offsets in _text_slices(batch, separators):
                hashes = kernels.trigram_hashes(data, offsets, joiner)
                value, n = np.unique(hashes[row[:-2] == row[2:]], return_counts=True)
                value = np.repeat(value, np.minimum(n, limit))
                number = (value >> np.uint64(64 - bits)).astype(np.int64)
                value = (value >> np.uint64(32 - bits)).astype(np.uint32)
                first = np.flatnonzero(np.append(True, number[1:] != number[:-1])[:len(number)])
                lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [
                    None, pa.py_buffer(np.append(first, len(value)) * 4), pa.py_buffer(value)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number[first]), lists.cast(pa.binary())], names=["range", "hashes"])

    def recurring(table: pa.Table) -> pa.Table:
        value = np.sort(np.concatenate(
            [np.frombuffer(h.as_buffer(), np.uint32) for h in table["hashes"]]))
        last = value[limit - 1:]
        found = last[last == value[:len(last)]].astype(np.uint64)
        found |= np.uint64(table["range"][0].as_py() << 32)
        place = np.unique(found >> np.uint64(32 + bits - PLACE_BITS))
        word, bit = place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63))
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1])[:len(word)])
        held = np.bitwise_or.reduceat(bit, first) if len(first) else bit
        return pa.table({"word": word[first].view(np.int64), "bits": held.view(np.int64)})

    with shuffles_dropped(texts.sparkSession):
        words = rows.mapInArrow(dealt, "range long, hashes binary").groupBy("range").applyInArrow(
            recurring, "word long, bits long").toArrow()
    table = np.zeros(1 << (PLACE_BITS - 6), np.int64)
    np.bitwise_or.at(table, words["word"].to_numpy(), words["bits"].to_numpy())
    shared = texts.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def joined(batches):
        for batch in batches:
            for utts, row, data, offsets in _text_slices(batch, separators):
                place = kernels.trigram_hashes(data, offsets, joiner) >> np.uint64(64 - PLACE_BITS)
                known = shared.value[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)
                at = np.flatnonzero((row[:-2] == row[2:]) & known.astype(bool))
                tokens = pa.LargeStringArray.from_buffers(
                    len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
                strings = pc.binary_join_element_wise(
                    *[tokens.take(pa.array(at + i)) for i in range(3)],
                    pa.scalar(joiner, pa.large_string()))
                each = pa.table({"row": row[at], "triphone": strings}).group_by(
                    ["row", "triphone"], use_threads=False).aggregate([]).combine_chunks()
                yield from pa.table({
                    "utt": utts.take(each["row"]), "triphone": each["triphone"].cast(pa.string()),
                }).to_batches()

    return rows.mapInArrow(joined, rows.select("utt").schema.add("triphone", "string"))


# --- transcripts ------------------------------------------------------------


def _label_words(lines: DataFrame, fields: int, silences: list[str]) -> DataFrame:
    """Label rows ``(utt, line_ix, line)`` with their word flags."""
    text = F.trim(F.regexp_replace("line", r"[\r\n]+$", ""))
    blanks = F.length(F.col("text")) - F.length(F.replace(F.col("text"), F.lit(" "), F.lit("")))
    rows = lines.withColumn("text", text).withColumn("blanks", blanks)
    last = F.substring_index("text", " ", -1)
    return rows.select(
        "utt", "line_ix",
        last.alias("last"),
        F.substring_index(F.substring_index("text", " ", -2), " ", 1).alias("before"),
        (F.col("blanks") == fields).alias("opens"),
        (F.col("blanks") == fields - 1).alias("goes_on"),
        last.isin(silences).alias("silent") if silences else F.lit(False).alias("silent"),
    )


def transcript_words(lines: DataFrame, fields: int = 3) -> DataFrame:
    """``(utt, word_ix, word)``: the last field of rows that open a word."""
    rows = _label_words(lines, fields, []).where("opens")
    rows = number_rows(rows, ["utt"], ["line_ix"], by_segment("line_ix"), "word_ix")
    return rows.select("utt", "word_ix", F.col("last").alias("word"))


def phonetic_words(
    lines: DataFrame, fields: int = 3, silences: Sequence[str] = ()
) -> DataFrame:
    """``(utt, word_ix, word)``: the phones of each word joined by '-'.

    A row that opens a word brings its first phone, rows that go on the next
    ones; silent rows are skipped. Phones before any word form word -1.
    """
    rows = _label_words(lines, fields, list(silences)).where(
        ~F.col("silent") & (F.col("opens") | F.col("goes_on"))
    )
    rows = running_total(
        rows, ["utt"], ["line_ix"], by_segment("line_ix"), F.col("opens").cast("int"), "_rank"
    ).withColumn("word_ix", (F.col("_rank") - 1).cast("int"))
    phone = F.when(F.col("opens"), F.col("before")).otherwise(F.col("last"))
    return _ordered_text(
        rows.select("utt", "word_ix", "line_ix", phone.alias("s")),
        ["utt", "word_ix"], "line_ix", "-", "word",
    )


def transcript_text(words: DataFrame, segment: int = 1024) -> DataFrame:
    """One string per utterance, joined in two steps so that the last one
    moves pieces of text and not words."""
    pieces = _ordered_text(
        words.select(
            "utt", F.floor(F.col("word_ix") / segment).alias("_seg"),
            "word_ix", F.col("word").alias("s"),
        ),
        ["utt", "_seg"], "word_ix", " ", "s",
    )
    return _ordered_text(pieces, ["utt"], "_seg", " ", "transcript")


def _ordered_text(rows, keys: list[str], order: str, joiner: str, name: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(order, "s")))
    return rows.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda r: r["s"]), joiner).alias(name)
    )

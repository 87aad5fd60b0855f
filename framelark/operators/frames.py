"""Frame numbering, bounded-neighbourhood windows and frame-grid helpers.

Frames are rows ``(utt, frame_ix, feats)`` with ``frame_ix`` running from 0
without holes. Every window here looks a bounded number of frames to each
side, so an utterance is cut into segments of ``SEGMENT`` frames, each with a
copied margin from its neighbours: a recording that holds a third of all rows
is then spread over many tasks, and results are the same as on the whole.
"""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelark.functions.vectors import of_width, vector, zeros
from framelark.session import cut_lineage

SEGMENT = 65_536
SALTS = 16


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Deal out a scan that has fewer splits than there are cores.

    Only a small table has so few; a large one is left as it is read.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, *keys) if scan.rdd.getNumPartitions() < cores else scan


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
    bucket: Column | None, value: Column, name: str, null_keys: bool = False,
) -> DataFrame:
    """Add the sum of ``value`` up to and including each row, along ``order``.

    ``bucket`` must not decrease along ``order``. Rows are summed up inside
    (keys, bucket); the bucket sums, a far smaller table, give the offsets.
    Without a bucket, rows are range-partitioned by keys and order, and the
    partition, once written down, serves as one. Unless ``null_keys``, a NULL key
    fails the job: offsets are joined by plain equality, for which the window's
    own partitioning serves.
    """
    if not null_keys:
        for k in keys:
            known = F.when(F.col(k).isNotNull(), True)
            df = df.where(known.otherwise(F.raise_error(F.lit(f"{k} is NULL"))))
    if bucket is None:
        spread = df.repartitionByRange(*keys, *order)
        tagged = cut_lineage(spread.withColumn("_bucket", F.spark_partition_id()))
    else:
        tagged = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    sums = tagged.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"))
    offsets = sums.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    local = tagged.withColumn("_local", F.sum(value).over(inside))
    match = F.col("_bucket") == F.col("_b")
    for k in keys:
        other = F.col(f"_{k}")
        match = match & (F.col(k).eqNullSafe(other) if null_keys else F.col(k) == other)
    return local.join(offsets, match).select(
        *df.columns, (F.col("_offset") + F.col("_local")).alias(name)
    )


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
    bucket: Column | None, name: str = "frame_ix", kind: str = "int",
    null_keys: bool = False,
) -> DataFrame:
    """Number rows 0.. within ``keys`` along ``order``, as in ``running_total``."""
    rows = running_total(df, keys, order, bucket, F.lit(1), name, null_keys)
    return rows.withColumn(name, (F.col(name) - 1).cast(kind))


def by_segment(ix: str, segment: int | None = None) -> Column:
    """Bucket for a running total along a position that already exists."""
    return F.floor(F.col(ix) / (SEGMENT if segment is None else segment))


def salted_join(
    frames: DataFrame, side: DataFrame, on: Sequence[str], how: str = "inner",
    spread: Column | None = None, salts: int = SALTS, null_safe: bool = False,
) -> DataFrame:
    """Join many rows to one row per key without a hot task for a hot key.

    ``side`` (one row per key) is copied ``salts`` times and the frames of a
    key are spread over the copies by ``spread`` (default: their number).
    With ``null_safe`` a NULL key meets a NULL key.
    """
    spread = F.col("frame_ix") if spread is None else spread
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    copies = side.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    if null_safe:
        return null_safe_join(
            frames.withColumn("_salt", salt), copies, [*on, "_salt"], how).drop("_salt")
    return frames.withColumn("_salt", salt).join(
        copies, [*on, "_salt"], how
    ).drop("_salt")


def null_safe_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on columns of both sides where NULL equals NULL."""
    side = right.withColumnsRenamed({k: f"_right_{k}" for k in on})
    match = F.lit(True)
    for k in on:
        match = match & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(side, match, how).drop(*[f"_right_{k}" for k in on])


def dimension_join(
    rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner",
    limit: int = 100_000,
) -> DataFrame:
    """Join a dimension table such as a phone chart: broadcast if it is counted
    to have at most ``limit`` rows, otherwise salted."""
    if table.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(table), list(on), how)
    return salted_join(rows, table, on, how, spread=F.xxhash64(*rows.columns))


def segmented(
    df: DataFrame, margin: int, ix: str = "frame_ix", segment: int | None = None
) -> DataFrame:
    """Copy each row to every segment whose margin it lies in (``_seg``)."""
    segment = SEGMENT if segment is None else segment
    here = F.col(ix)
    first = F.floor(F.greatest(here - margin, F.lit(0)) / segment)
    last = F.floor((here + margin) / segment)
    return df.withColumn("_seg", F.explode(F.sequence(first, last)))


def core_only(
    df: DataFrame, ix: str = "frame_ix", segment: int | None = None
) -> DataFrame:
    """Drop the copied margins again."""
    segment = SEGMENT if segment is None else segment
    return df.where(F.col("_seg") == F.floor(F.col(ix) / segment)).drop("_seg")


def segment_window(keys: Sequence[str] = ("utt",), ix: str = "frame_ix"):
    return Window.partitionBy(*keys, "_seg").orderBy(ix)


def _neighbours(column: str, lags: Sequence[int], keys: Sequence[str], ix: str):
    """Columns at t-lag and t+lag, the edge value repeated beyond the edges.

    Only the true ends of a series lack a neighbour for a row that is kept, so
    the first and last row of the segment are the series' own edges there.
    """
    w = segment_window(keys, ix)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(column).over(whole), F.last(column).over(whole)
    named = {}
    for k in lags:
        named[f"_past{k}"] = F.coalesce(F.lag(column, k).over(w), first)
        named[f"_next{k}"] = F.coalesce(F.lead(column, k).over(w), last)
    return named


def simple_difference(
    frames: DataFrame, lag: int, width: int, segment: int | None = None
) -> DataFrame:
    """``feats`` becomes x[t+lag] - x[t-lag], indices clamped to the series."""
    rows = segmented(of_width(frames, width), lag, segment=segment)
    rows = rows.withColumns(_neighbours("feats", [lag], ["utt"], "frame_ix"))
    diff = vector(
        lambda nxt, past: nxt - past,
        F.col(f"_next{lag}"), F.col(f"_past{lag}"), width=width,
    )
    return core_only(
        rows.withColumn("feats", diff).drop(f"_next{lag}", f"_past{lag}"),
        segment=segment,
    )


def _add_delta(rows: DataFrame, source: str, out: str, window: int, width: int):
    lags = range(1, window + 1)
    named = _neighbours(source, lags, ["utt"], "frame_ix")
    norm = 2 * sum(k * k for k in lags)
    arrays = [F.col(name) for name in named]

    def regression(*values: Column) -> Column:
        # values: past1, next1, past2, next2, ...
        terms = [
            (values[2 * i + 1] - values[2 * i]) * k for i, k in enumerate(lags)
        ]
        acc = terms[0]
        for term in terms[1:]:
            acc = acc + term
        return acc / norm

    rows = rows.withColumns(named)
    return rows.withColumn(out, vector(regression, *arrays, width=width)).drop(*named)


def delta(
    frames: DataFrame, width: int, window: int = 5, segment: int | None = None
) -> DataFrame:
    """``feats`` becomes its regression slope over +-``window`` frames."""
    rows = segmented(of_width(frames, width), window, segment=segment)
    rows = _add_delta(rows, "feats", "feats", window, width)
    return core_only(rows, segment=segment)


def dynamic_features(
    frames: DataFrame, width: int, window: int = 5, segment: int | None = None
) -> DataFrame:
    """``feats`` becomes [static, delta, delta of delta].

    Both steps share one shuffle: the margin is twice the window, so that the
    first slope is right for every frame the second one looks at.
    """
    rows = segmented(of_width(frames, width), 2 * window, segment=segment)
    rows = _add_delta(rows, "feats", "_delta", window, width)
    rows = _add_delta(rows, "_delta", "_delta2", window, width)
    rows = rows.withColumn("feats", F.concat("feats", "_delta", "_delta2"))
    return core_only(rows.drop("_delta", "_delta2"), segment=segment)


def context_windows(
    frames: DataFrame, width: int, window: int = 5, zero_padding: bool = True,
    segment: int | None = None,
) -> DataFrame:
    """Concatenate frames t-window .. t+window.

    With zero padding missing frames count as zeros; without, only frames that
    have all neighbours are kept and they are renumbered from 0.
    """
    if window == 0:
        return frames
    w = segment_window()
    blank = zeros(width)
    rows = segmented(frames, window, segment=segment)
    named = {
        f"_c{i}": F.lag("feats", window - i).over(w) for i in range(2 * window + 1)
    }
    rows = rows.withColumns(named)
    if not zero_padding:
        rows = rows.where(
            F.col("_c0").isNotNull() & F.col(f"_c{2 * window}").isNotNull()
        )
    joined = F.concat(*[F.coalesce(F.col(name), blank) for name in named])
    rows = core_only(rows.withColumn("feats", joined).drop(*named), segment=segment)
    if not zero_padding:
        rows = rows.withColumn("frame_ix", F.col("frame_ix") - window)
    return rows


def fir_taps(cutoff: float, sampling_rate: float, window: int) -> list[float]:
    """Hamming-windowed sinc of half-width ``window``."""
    f = 2 * cutoff / sampling_rate
    taps = []
    for k in range(-window, window + 1):
        bell = 0.54 - 0.46 * math.cos(math.pi * (k + window) / window)
        arg = math.pi * f * k
        taps.append(bell * f * (1.0 if k == 0 else math.sin(arg) / arg))
    return taps


def lowpass_fir(
    frames: DataFrame, cutoffs: float | Sequence[float], width: int,
    sampling_rate: float = 200, window: int = 5, segment: int | None = None,
) -> DataFrame:
    """Per-channel FIR low-pass, zeros beyond the ends, same length."""
    if not isinstance(cutoffs, Sequence):
        cutoffs = [cutoffs] * width
    if len(cutoffs) != width:
        raise ValueError("one cutoff per channel is needed")
    taps = [fir_taps(c, sampling_rate, window) for c in cutoffs]
    w = segment_window()
    rows = segmented(of_width(frames, width), window, segment=segment)
    named = {
        f"_f{i}": F.coalesce(F.lag("feats", window - i).over(w), zeros(width))
        for i in range(2 * window + 1)
    }
    weights = [F.lit([t[i] for t in taps]) for i in range(2 * window + 1)]

    def weighted(*values: Column) -> Column:
        half = len(values) // 2
        acc = values[0] * values[half]
        for x, h in zip(values[1:half], values[half + 1:]):
            acc = acc + x * h
        return acc

    rows = rows.withColumns(named)
    filtered = vector(weighted, *[F.col(n) for n in named], *weights, width=width)
    return core_only(rows.withColumn("feats", filtered).drop(*named), segment=segment)


def lengths(frames: DataFrame, keys: Sequence[str] = ("utt",)) -> DataFrame:
    """Frames per utterance; the largest number counts, so partial sums suffice."""
    return frames.groupBy(*keys).agg((F.max("frame_ix") + 1).cast("int").alias("n"))


def with_length(frames: DataFrame) -> DataFrame:
    return salted_join(frames, lengths(frames), ["utt"])


def crop_edges(frames: DataFrame, window: int) -> DataFrame:
    """Drop ``window`` frames at both ends and renumber from 0."""
    kept = with_length(frames).where(
        (F.col("frame_ix") >= window) & (F.col("frame_ix") < F.col("n") - window)
    )
    return kept.withColumn("frame_ix", F.col("frame_ix") - window).drop("n")


def truncate(frames: DataFrame, length: int) -> DataFrame:
    return frames.where(F.col("frame_ix") < length)


def delta_matrix(lengths_table: DataFrame, window: int = 5) -> DataFrame:
    """The slope operator as a relation ``(utt, t, s, w)``: delta_t = sum w x_s."""
    norm = 2 * sum(k * k for k in range(1, window + 1))
    n = F.col("n")
    cells = lengths_table.select(
        "utt", "n", F.explode(F.sequence(F.lit(0), n - 1)).alias("t")
    )
    lags = F.array(*[F.lit(k) for k in range(-window, window + 1) if k])
    cells = cells.select("utt", "n", "t", F.explode(lags).alias("k"))
    s = F.least(F.greatest(F.col("t") + F.col("k"), F.lit(0)), n - 1)
    return (
        cells.select("utt", "t", s.alias("s"), "k")
        .groupBy("utt", "t", "s")
        .agg((F.sum("k") / norm).alias("w"))
    )


def padded_batch(frames: DataFrame, width: int, length: int | None = None) -> DataFrame:
    """Every utterance brought to one length by zero frames.

    The batch stays in rows: ``(utt, frame_ix, feats, length)`` with ``length``
    the true (possibly truncated) number of frames. Without ``length`` the
    longest utterance sets it.
    """
    sizes = lengths(frames)
    if length is None:
        target = sizes.agg(F.max("n").alias("n")).scalar()
    else:
        target = F.lit(length)
    sizes = sizes.select(
        "utt", F.least(F.col("n"), target).cast("int").alias("length"),
        target.alias("_target"),
    )
    kept = salted_join(frames.select("utt", "frame_ix", "feats"), sizes, ["utt"])
    kept = kept.where(F.col("frame_ix") < F.col("length")).drop("_target")
    blank = (
        sizes.where(F.col("length") < F.col("_target"))
        .select(
            "utt",
            F.explode(F.sequence(F.col("length"), F.col("_target") - 1)).alias("frame_ix"),
            zeros(width).alias("feats"), "length",
        )
    )
    return kept.unionByName(blank)


def unpadded(batch: DataFrame) -> DataFrame:
    """Inverse of ``padded_batch``: only the true frames."""
    return batch.where(F.col("frame_ix") < F.col("length")).drop("length")


def packed_batch(frames: DataFrame, width: int, length: int) -> DataFrame:
    """One row per utterance: ``feats ARRAY<ARRAY<DOUBLE>>`` of exactly ``length``.

    The fixed length bounds what is gathered into one row.
    """
    rows = truncate(frames, length).groupBy("utt").agg(
        F.array_sort(F.collect_list(F.struct("frame_ix", "feats"))).alias("rows")
    )
    true = F.transform("rows", lambda r: r["feats"])
    blank = F.array_repeat(zeros(width), F.lit(length) - F.size("rows"))
    return rows.select("utt", F.concat(true, blank).alias("feats"),
                       F.size("rows").alias("length"))


def unpacked_batch(batch: DataFrame) -> DataFrame:
    rows = batch.select("utt", "length", F.posexplode("feats").alias("frame_ix", "feats"))
    return unpadded(rows)


def sequence_mask(batch: DataFrame) -> DataFrame:
    """``mask`` is 1 on true frames of a padded batch and 0 on padding."""
    return batch.withColumn(
        "mask", (F.col("frame_ix") < F.col("length")).cast("double")
    )


def long_form(frames: DataFrame, *keep: str) -> DataFrame:
    """One row per (frame, channel)."""
    return frames.select(*keep, F.posexplode("feats").alias("channel", "value"))

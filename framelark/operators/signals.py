"""Signals on Spark: framing, energy, prediction, cepstra, gaps, filters, rates.

Audio is kept in blocks ``(utt, block_ix, samples)`` of at most ``BLOCK``
samples, so that no row holds a whole recording.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelark.functions import kernels
from framelark.functions.vectors import dot
from framelark.operators.frames import (
    by_segment, core_only, dynamic_features, lengths, running_total, salted_join,
    segment_window, segmented,
)
from framelark.operators.models import list_column, map_vectors, matrix
from framelark.operators.spectra import resample_long

BLOCK = 16_000


# --- framing ----------------------------------------------------------------


def blocks(
    samples: DataFrame, ix: str = "sample_ix", value: str = "value", block: int = BLOCK
) -> DataFrame:
    """Pack long samples ``(utt, ix, value)`` into blocks of a fixed size."""
    rows = samples.groupBy("utt", F.floor(F.col(ix) / block).alias("block_ix")).agg(
        F.array_sort(F.collect_list(F.struct(ix, value))).alias("_s")
    )
    return rows.select(
        "utt", "block_ix",
        F.transform("_s", lambda s: s[value].cast("double")).alias("samples"),
    )


def framed(
    audio: DataFrame, length: int, hop: int, centred: bool = False, block: int = BLOCK
) -> DataFrame:
    """Overlapping frames ``(utt, frame_ix, feats)`` of ``length`` samples.

    Plain frames start at ``frame_ix * hop`` and incomplete ones are dropped.
    Centred frames have their middle there; the signal is mirrored at its ends.
    A frame is cut out of the block its mark falls into, extended by what it
    needs of the neighbouring blocks.
    """
    if not 0 < hop or not 0 < length <= block:
        raise ValueError("frames must fit into one block")
    half = length // 2 if centred else 0
    w = segment_window(ix="block_ix")
    rows = segmented(audio.select("utt", "block_ix", "samples"), 2, "block_ix")
    rows = rows.withColumns({
        "_back": F.lag("samples", 1).over(w),
        "_next": F.lead("samples", 1).over(w),
        "_after": F.lead("block_ix", 2).over(w),
    })
    rows = core_only(rows, "block_ix")
    empty = F.array().cast("array<double>")
    ahead = F.coalesce(F.col("_next"), empty)
    known = F.concat(F.col("samples"), ahead)
    if centred:
        mirror_left = F.reverse(F.slice(known, 2, half))
        left = F.when(F.col("_back").isNull(), mirror_left).otherwise(
            F.slice("_back", -half, half)
        )
        # With no block after the next one, the signal ends inside ``known``.
        whole = F.concat(F.coalesce(F.col("_back"), empty), known)
        mirror_right = F.reverse(F.slice(whole, F.size(whole) - half, half))
        known = F.concat(
            left, known, F.when(F.col("_after").isNull(), mirror_right).otherwise(empty)
        )
    rows = rows.select(
        "utt", "block_ix", known.alias("_known"),
        F.col("_next").isNull().alias("_is_last"), F.size("samples").alias("_n"),
    )
    # Marks of this block, counted from its first sample; the last block of a
    # centred signal also owns a mark right behind its last sample.
    offset = F.col("block_ix") * block
    first = F.ceil(offset / F.lit(hop))
    room = F.size("_known") - length
    inside = F.col("_n") - 1 + F.when(F.col("_is_last") & F.lit(centred), 1).otherwise(0)
    last = F.floor((offset + F.least(room, inside)) / F.lit(hop))
    rows = rows.withColumns({"_first": first, "_last": last}).where(
        (F.col("_last") >= F.col("_first")) & (F.least(room, inside) >= 0)
    )
    rows = rows.select(
        "utt", "block_ix", "_known", F.explode(F.sequence("_first", "_last")).alias("_f")
    )
    start = (F.col("_f") * hop - F.col("block_ix") * block + 1).cast("int")
    return rows.select(
        "utt", F.col("_f").cast("int").alias("frame_ix"),
        F.slice("_known", start, F.lit(length)).alias("feats"),
    )


def frame_sizes(
    sampling_rate: float, frame_time: float = 25, hop_time: float = 10
) -> tuple[int, int]:
    """Milliseconds to samples, both rounded down."""
    return int(frame_time * sampling_rate / 1000), int(hop_time * sampling_rate / 1000)


def rms_energy(
    audio: DataFrame, length: int, hop: int, centred: bool = True, block: int = BLOCK
) -> DataFrame:
    """One channel: the root mean square of each frame."""
    energy = F.sqrt(dot(F.col("feats"), F.col("feats")) / length)
    rows = framed(audio, length, hop, centred, block)
    return rows.select("utt", "frame_ix", F.array(energy).alias("feats"))


# --- acoustic features ------------------------------------------------------


def lpc_frames(frames: DataFrame, length: int, n_coeff: int = 20) -> DataFrame:
    """Prediction coefficients of framed samples."""
    return map_vectors(frames, lambda x: kernels.linear_prediction(x, n_coeff)[0], length)


def lpc_with_error(frames: DataFrame, length: int, n_coeff: int = 20) -> DataFrame:
    """Prediction coefficients followed by the RMS prediction error."""
    def both(x: np.ndarray) -> np.ndarray:
        a, error = kernels.linear_prediction(x, n_coeff)
        return np.concatenate([a, error[:, None]], axis=1)

    return map_vectors(frames, both, length)


def lpc_to_lsf(frames: DataFrame, n_lpc: int) -> DataFrame:
    return map_vectors(frames, kernels.line_spectrum, n_lpc)


def lsf_to_lpc(frames: DataFrame, n_lsf: int) -> DataFrame:
    return map_vectors(frames, kernels.prediction_from_lines, n_lsf)


def lsf_frames(frames: DataFrame, length: int, n_coeff: int = 20) -> DataFrame:
    """Line spectral frequencies, from one prediction coefficient more."""
    def lines(x: np.ndarray) -> np.ndarray:
        return kernels.line_spectrum(kernels.linear_prediction(x, n_coeff + 1)[0])

    return map_vectors(frames, lines, length)


def mfcc_frames(
    frames: DataFrame, length: int, sampling_rate: float, n_coeff: int = 13,
    n_mels: int = 128, top_db: float = 80.0,
) -> DataFrame:
    """Mel cepstra of framed samples.

    Band powers are cut off ``top_db`` below the loudest band of the utterance,
    which one partial aggregation finds.
    """
    bank = kernels.mel_bank(sampling_rate, length, n_mels)
    basis = kernels.cosine_basis(n_coeff, n_mels)
    loud = map_vectors(frames, lambda x: kernels.mel_decibels(x, bank), length)
    floor = loud.groupBy("utt").agg(
        (F.max(F.array_max("feats")) - top_db).alias("_floor")
    )
    cut = salted_join(loud, floor, ["utt"])
    cut = cut.withColumn(
        "feats", F.transform("feats", lambda x: F.greatest(x, F.col("_floor")))
    ).drop("_floor")
    return map_vectors(cut, lambda x: x @ basis.T, n_mels)


def _with_energy(frames: DataFrame, energy: DataFrame) -> DataFrame:
    """Append the energy channel, cut to the shorter of the two."""
    e = energy.select("utt", "frame_ix", F.col("feats").alias("_e"))
    return (
        frames.join(e, ["utt", "frame_ix"])
        .withColumn("feats", F.concat("feats", "_e")).drop("_e")
    )


def get_mfcc(audio, sampling_rate, length, hop, n_coeff=13, static_only=False, block=BLOCK):
    rows = mfcc_frames(
        framed(audio, length, hop, True, block), length, sampling_rate, n_coeff
    )
    return rows if static_only else dynamic_features(rows, n_coeff)


def get_lpc(audio, sampling_rate, length, hop, n_coeff=20, static_only=False, block=BLOCK):
    rows = lpc_frames(framed(audio, length, hop, False, block), length, n_coeff)
    if static_only:
        return rows
    rows = _with_energy(rows, rms_energy(audio, length, hop, block=block))
    return dynamic_features(rows, n_coeff + 1)


def get_lsf(audio, sampling_rate, length, hop, n_coeff=20, static_only=False, block=BLOCK):
    rows = lsf_frames(framed(audio, length, hop, False, block), length, n_coeff)
    if static_only:
        return rows
    rows = _with_energy(rows, rms_energy(audio, length, hop, block=block))
    return dynamic_features(rows, n_coeff + 1)


# A user adds a kind of features by adding a function of the same signature.
AUDIO_FEATURES: dict[str, Callable[..., DataFrame]] = {
    "mfcc": get_mfcc, "lpc": get_lpc, "lsf": get_lsf,
}


def audio_width(form: str, n_coeff: int, static_only: bool = False) -> int:
    """Channels of a form: lpc and lsf carry the energy beside the coefficients."""
    if static_only:
        return n_coeff
    return 3 * (n_coeff if form == "mfcc" else n_coeff + 1)


def audio_features(
    audio: DataFrame, form: str, sampling_rate: float, n_coeff: int = 13,
    static_only: bool = False, frame_time: float = 25, hop_time: float = 10,
    block: int = BLOCK,
) -> DataFrame:
    """Features of audio blocks by name."""
    if form not in AUDIO_FEATURES:
        raise ValueError(f"unknown features {form!r}; there are {sorted(AUDIO_FEATURES)}")
    length, hop = frame_sizes(sampling_rate, frame_time, hop_time)
    return AUDIO_FEATURES[form](
        audio, sampling_rate, length, hop, n_coeff, static_only, block
    )


# --- gaps -------------------------------------------------------------------

KNOT_MARGIN = 96


def fill_gaps(frames: DataFrame, width: int, segment: int | None = None) -> DataFrame:
    """Replace NaN (or NULL) by an interpolating cubic spline over the frame number.

    Only channels with gaps take part. Their knots (the finite values) are
    numbered and cut into segments with a margin beyond which a spline forgets
    its far ends; each segment gives the polynomials of its gaps, and the gaps'
    frames are then evaluated by a join. Ends are extrapolated.
    """
    cells = frames.select("utt", "frame_ix", F.posexplode("feats").alias("channel", "value"))
    gap = F.col("value").isNull() | F.isnan("value")
    broken = cells.where(gap).select("utt", "channel").distinct()
    cells = salted_join(cells, broken, ["utt", "channel"])
    cells = running_total(
        cells, ["utt", "channel"], ["frame_ix"], by_segment("frame_ix", segment),
        (~gap).cast("int"), "knot",
    ).withColumn("knot", F.col("knot") - 1)
    knots = segmented(cells.where(~gap), KNOT_MARGIN, "knot", segment)
    size = knots_per_segment(segment)
    schema = (
        "utt " + frames.schema["utt"].dataType.simpleString()
        + ", channel int, knot bigint, x0 double, y0 double, b double, c double, d double"
    )

    def polynomials(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("knot")
        knot = table["knot"].to_numpy()
        x = table["frame_ix"].to_numpy().astype(float)
        y = table["value"].to_numpy()
        first = key[2].as_py() * size
        starts, ends = knot[0] == 0, knot[-1] < first + size - 1 + KNOT_MARGIN
        if len(x) < 4:
            if starts and ends:
                raise ValueError(f"{key[0].as_py()}: a spline needs 4 finite values")
            return _no_rows(table, schema)
        m = kernels.spline_second_derivatives(x, y, starts, ends)
        h = np.diff(x)
        b = np.diff(y) / h - h * (2 * m[:-1] + m[1:]) / 6
        coefs = np.stack([x[:-1], y[:-1], b, m[:-1] / 2, np.diff(m) / (6 * h)], axis=1)
        own = (knot[:-1] >= first) & (knot[:-1] < first + size)
        wanted = own & (h > 1)
        ids, rows = [knot[:-1][wanted]], [coefs[wanted]]
        if starts and first == 0:
            ids.append([-1])
            rows.append(coefs[:1])
        if ends and first <= knot[-1] < first + size:
            ids.append([knot[-1]])
            rows.append(coefs[-1:])
        ids, rows = np.concatenate(ids).astype(np.int64), np.concatenate(rows)
        n = len(ids)
        columns = [
            pa.repeat(key[0], n), pa.repeat(pa.scalar(key[1].as_py(), pa.int32()), n),
            pa.array(ids), *[pa.array(c) for c in rows.T],
        ]
        return pa.table(columns, names=_POLY)

    polys = knots.select("utt", "channel", "_seg", "knot", "frame_ix", "value").groupBy(
        "utt", "channel", "_seg"
    ).applyInArrow(polynomials, schema)
    missing = cells.where(gap).select("utt", "channel", "frame_ix", "knot")
    at = salted_join(missing, polys, ["utt", "channel", "knot"])
    t = F.col("frame_ix") - F.col("x0")
    value = F.col("y0") + t * (F.col("b") + t * (F.col("c") + t * F.col("d")))
    filled = at.groupBy("utt", "frame_ix").agg(
        F.map_from_entries(F.collect_list(F.struct("channel", value.alias("v")))).alias("_new")
    )
    rows = frames.join(filled, ["utt", "frame_ix"], "left")
    feats = F.transform(
        "feats",
        lambda x, i: F.coalesce(F.try_element_at("_new", i), x),
    )
    feats = F.when(F.col("_new").isNull(), F.col("feats")).otherwise(feats)
    return rows.withColumn("feats", feats).select(*frames.columns)


_POLY = ["utt", "channel", "knot", "x0", "y0", "b", "c", "d"]


def knots_per_segment(segment: int | None) -> int:
    from framelark.operators import frames as fr

    return fr.SEGMENT if segment is None else segment


def _no_rows(table: pa.Table, schema: str) -> pa.Table:
    kinds = [table["utt"].type, pa.int32(), pa.int64(), *[pa.float64()] * 5]
    return pa.table([pa.array([], k) for k in kinds], names=_POLY)


# --- zero-phase low-pass ----------------------------------------------------


def lowpass_filter(
    frames: DataFrame, cutoff: float, sampling_rate: float, width: int, order: int = 5,
    segment: int | None = None,
) -> DataFrame:
    """Butterworth low-pass applied forward and backward, per channel.

    A stable filter forgets: segments get a margin in which its memory falls
    below double precision, so the parts join as if filtered in one piece.
    """
    _, poles, _ = kernels.butterworth(order, cutoff, sampling_rate)
    margin = kernels.fade_length(poles)
    size = knots_per_segment(segment)
    rows = segmented(frames.select("utt", "frame_ix", "feats"), margin, segment=segment)

    def smooth(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("frame_ix")
        ix = table["frame_ix"].to_numpy()
        first = key[1].as_py() * size
        last = first + size - 1
        own = (ix >= first) & (ix <= last)
        if not own.any():
            return table.slice(0, 0).select(["utt", "frame_ix", "feats"])
        x = matrix(table["feats"], width)
        x = kernels.zero_phase_lowpass(
            x, order, cutoff, sampling_rate, ix[0] == 0, ix[-1] < last + margin
        )
        table = table.select(["utt", "frame_ix"]).append_column("feats", list_column(x))
        return table.filter(pa.array(own))

    schema = rows.select("utt", "frame_ix", "feats").schema
    smoothed = rows.groupBy("utt", "_seg").applyInArrow(smooth, schema)
    return _back_on(frames, smoothed)


def _back_on(frames: DataFrame, changed: DataFrame) -> DataFrame:
    """Put new ``feats`` beside the other columns, if there are any."""
    rest = [c for c in frames.columns if c != "feats"]
    if set(rest) == {"utt", "frame_ix"}:
        return changed.select(*frames.columns)
    return frames.select(*rest).join(changed, ["utt", "frame_ix"]).select(*frames.columns)


# --- sampling rate ----------------------------------------------------------

WHOLE_LIMIT = 1 << 22


def resample(
    frames: DataFrame, from_rate: float, to_rate: float, width: int,
    whole_limit: int = WHOLE_LIMIT,
) -> DataFrame:
    """Change the frame rate through the spectrum; ``n * ratio`` is rounded down.

    A spectrum needs all of a series. Series of up to ``whole_limit`` frames
    are transformed in one task each; longer ones by a transform that is itself
    spread over tasks.
    """
    rows = frames.select("utt", "frame_ix", "feats")
    if from_rate == to_rate:
        return rows
    ratio = to_rate / from_rate
    sizes = lengths(rows)
    long_sizes = sizes.where(F.col("n") > whole_limit)
    has_long = long_sizes.limit(1).count() > 0
    if has_long:
        flagged = salted_join(rows, sizes, ["utt"])
        short = flagged.where(F.col("n") <= whole_limit).drop("n")
        tall = flagged.where(F.col("n") > whole_limit)
    else:
        short, tall = rows, None

    def whole(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("frame_ix")
        x = matrix(table["feats"], width)
        n_out = int(len(x) * ratio)
        if n_out == 0:
            return table.slice(0, 0)
        y = kernels.fft_resample(x, n_out)
        return pa.table(
            [pa.repeat(key[0], n_out), pa.array(np.arange(n_out, dtype=np.int32)),
             list_column(y)], names=["utt", "frame_ix", "feats"],
        )

    done = short.groupBy("utt").applyInArrow(whole, rows.schema)
    if tall is None:
        return done
    return done.unionByName(resample_long(tall, ratio, width))

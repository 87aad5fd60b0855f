"""Choosing, joining and placing channels."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelark.functions.vectors import interlaced, of_width, pick, vector


def channel_indices(names: Sequence[str], wanted: Sequence[str]) -> list[int]:
    """Positions of the wanted channels; unknown names are an error."""
    names = [n.strip() for n in names]
    wanted = [n.strip() for n in wanted]
    unknown = [n for n in wanted if n not in names]
    if unknown:
        raise KeyError(f"unknown channels {unknown}; valid ones are {names}")
    return [names.index(n) for n in wanted]


def select_channels(
    frames: DataFrame, names: Sequence[str], wanted: Sequence[str]
) -> DataFrame:
    """Project by channel name, in the asked order."""
    return keep_channels(frames, channel_indices(names, wanted))


def keep_channels(frames: DataFrame, indices: Sequence[int] | None) -> DataFrame:
    """Project by position; nothing given keeps all."""
    if not indices:
        return frames
    return frames.withColumn("feats", pick(F.col("feats"), indices))


def scale(frames: DataFrame, factor: float, width: int) -> DataFrame:
    return of_width(frames, width).withColumn(
        "feats", vector(lambda x: x * factor, F.col("feats"), width=width)
    )


def interlace(
    frames: DataFrame, binary: Column, n_main: int, positions: Sequence[int]
) -> DataFrame:
    """Place binary channels among the continuous ones of ``feats``."""
    return frames.withColumn(
        "feats", interlaced(F.col("feats"), n_main, binary, positions)
    )


def checked_width(frames: DataFrame, width: int) -> DataFrame:
    """Fail the job on a frame whose vector has another width."""
    message = F.concat(
        F.lit(f"expected {width} channels in "), F.col("utt").cast("string")
    )
    return frames.withColumn(
        "feats",
        F.when(F.size("feats") == width, F.col("feats")).otherwise(F.raise_error(message)),
    )


def concat_features(left: DataFrame, right: DataFrame) -> DataFrame:
    """Channels of both sides per frame; unequal lengths fail the job.

    Frames are joined on (utt, frame_ix), so a long utterance spreads over all
    tasks. The full join shows a frame that one side lacks.
    """
    other = right.select("utt", "frame_ix", F.col("feats").alias("_right"))
    both = left.join(other, ["utt", "frame_ix"], "full")
    unequal = F.raise_error(
        F.concat(F.lit("features of unequal length: "), F.col("utt").cast("string"))
    )
    feats = F.when(
        F.col("feats").isNotNull() & F.col("_right").isNotNull(),
        F.concat("feats", "_right"),
    ).otherwise(unequal)
    return both.withColumn("feats", feats).drop("_right")


def append_voicing(
    ema: DataFrame, voicing: DataFrame, n_static: int, dynamic: bool
) -> DataFrame:
    """Add the voicing channel: after the static block when dynamic, else last."""
    flag = voicing.select("utt", "frame_ix", F.col("voiced").alias("_v"))
    rows = ema.join(flag, ["utt", "frame_ix"])
    value = F.array(F.col("_v"))
    if dynamic:
        feats = F.concat(
            F.slice("feats", 1, n_static), value,
            F.slice("feats", n_static + 1, 2 * n_static),
        )
    else:
        feats = F.concat(F.col("feats"), value)
    return rows.withColumn("feats", feats).drop("_v")

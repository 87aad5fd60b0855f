"""Modular loading of acoustic inputs and articulator targets."""

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelark.functions.scalars import parse_feature_name
from framelark.operators.channels import (
    append_voicing, channel_indices, concat_features, keep_channels,
)
from framelark.operators.filesets import in_fileset
from framelark.operators.frames import context_windows, crop_edges, dynamic_features
from framelark.operators.moments import demean, normalize


@dataclass(frozen=True)
class LoadingSetup:
    """Defaults of the loaders; ``dataclasses.replace`` overrides single ones.

    ``articulators`` other than a list means all of them, voicing included.
    """

    audio_type: str = "mfcc_stds"
    articulators: str | Sequence[str] = "all"
    context_window: int = 5
    dynamic_ema: bool = True
    ema_norm: str = "mean"
    zero_padding: bool = True

    @classmethod
    def by_speaker(cls) -> "LoadingSetup":
        """Defaults of a corpus of several speakers."""
        return cls(audio_type="mfcc_stds_byspeaker", ema_norm="mean_byspeaker")


# Suffix of a normalisation name -> scope of its moments.
SCOPES = {"": "corpus", "byspeaker": "speaker", "byfile": "file"}


def parse_norm(norm: str) -> tuple[str, str]:
    """``stds_byspeaker`` -> (``stds``, ``speaker``)."""
    kind, _, suffix = norm.partition("_")
    if suffix not in SCOPES:
        raise ValueError(f"unknown normalisation {norm!r}")
    return kind, SCOPES[suffix]


def normalized(frames: DataFrame, norm: str, width: int,
               moments: DataFrame | None = None) -> DataFrame:
    """Frames under a named normalisation; the empty name leaves them raw."""
    if not norm:
        return frames
    kind, scope = parse_norm(norm)
    if kind == "mean":
        return demean(frames, scope, width, moments)
    return normalize(frames, kind, scope, width, moments)


#: Keeps the frames of some utterances.
Pick = Callable[[DataFrame], DataFrame] | None


def load_acoustic(
    kinds: dict[str, DataFrame], widths: dict[str, int], setup: LoadingSetup,
    moments: DataFrame | None = None, picked: Pick = None,
) -> DataFrame:
    """Acoustic frames of ``setup.audio_type``, in context windows.

    ``picked`` keeps some utterances, once moments of all are applied and
    before windows multiply what a frame holds.
    """
    kind, norm = parse_feature_name(setup.audio_type)
    if kind not in kinds:
        raise KeyError(f"no features of kind {kind!r}; there are {sorted(kinds)}")
    rows = normalized(kinds[kind], norm, widths[kind], moments)
    return context_windows(
        picked(rows) if picked else rows, widths[kind], setup.context_window, setup.zero_padding
    )


def load_ema(
    ema: DataFrame, names: Sequence[str], setup: LoadingSetup,
    voicing: DataFrame | None = None, moments: DataFrame | None = None, picked: Pick = None,
) -> DataFrame:
    """Articulator frames: normalised, chosen by name, with dynamics and voicing.

    A list of articulators brings voicing only when it names it; without a list
    voicing always comes along. ``picked`` as in ``load_acoustic``.
    """
    rows = normalized(ema, setup.ema_norm, len(names), moments)
    rows = picked(rows) if picked else rows
    chosen, with_voicing = list(names), True
    if isinstance(setup.articulators, (list, tuple)):
        wanted = list(setup.articulators)
        with_voicing = "voicing" in wanted
        chosen = [n for n in wanted if n != "voicing"]
        rows = keep_channels(rows, channel_indices(names, chosen))
    if setup.dynamic_ema:
        rows = dynamic_features(rows, len(chosen))
    if with_voicing:
        if voicing is None:
            raise ValueError("voicing was asked for but not given")
        rows = append_voicing(rows, voicing, len(chosen), setup.dynamic_ema)
    return rows


def load_dataset(
    kinds: dict[str, DataFrame], widths: dict[str, int], names: Sequence[str],
    setup: LoadingSetup, voicing: DataFrame | None = None,
    filesets: DataFrame | None = None, set_name: str | None = None,
    acoustic_moments: DataFrame | None = None, ema_moments: DataFrame | None = None,
) -> DataFrame:
    """``(utt, frame_ix, acoustic, ema)`` of one fileset (of all, when none is named).

    Moments are those of the whole corpus, so they are taken before the
    fileset's utterances are picked.
    """
    picked = None
    if set_name is not None:
        if filesets is None:
            raise ValueError("a set was named but no filesets are given")

        def picked(rows: DataFrame) -> DataFrame:
            return in_fileset(rows, filesets, set_name)

    acoustic = load_acoustic(kinds, widths, setup, acoustic_moments, picked)
    ema = load_ema(kinds["ema"], names, setup, voicing, ema_moments, picked)
    if setup.context_window and not setup.zero_padding:
        ema = crop_edges(ema, setup.context_window)
    left = acoustic.select("utt", "frame_ix", F.col("feats").alias("acoustic"))
    right = ema.select("utt", "frame_ix", F.col("feats").alias("ema"))
    return left.join(right, ["utt", "frame_ix"])


def abx_features(
    kinds: dict[str, DataFrame], widths: dict[str, int], names: Sequence[str],
    audio_features: str | None = None, ema_features: str | None = None,
    invert=None, input_width: int | None = None, articulators="all",
    dynamic_ema: bool = True, voicing: DataFrame | None = None,
    sampling_rate: float = 100,
) -> DataFrame:
    """Features to discriminate phones by: acoustic, articulator, both, or the
    articulators a model predicts from the acoustic ones.

    ``invert`` maps frames to frames; a model whose input width is a multiple
    of 11 reads context windows of half-size 5. ``time`` labels each frame.
    """
    if audio_features is None and ema_features is None:
        raise RuntimeError("no features were chosen")
    if invert is not None and audio_features is None:
        raise RuntimeError("the model needs acoustic features")
    if invert is not None and ema_features is not None:
        raise RuntimeError("choose either articulator features or a model")
    if invert is not None and input_width is None:
        raise RuntimeError("the model's input width is needed")
    audio = ema = None
    if audio_features is not None:
        window = 5 if invert is not None and input_width % 11 == 0 else 0
        setup = LoadingSetup(audio_type=audio_features, context_window=window)
        audio = load_acoustic(kinds, widths, setup)
    if ema_features is not None:
        setup = LoadingSetup(
            articulators=articulators, ema_norm=ema_features, dynamic_ema=dynamic_ema
        )
        ema = load_ema(kinds["ema"], names, setup, voicing)
    if invert is not None:
        rows = invert(audio)
    elif audio is not None and ema is not None:
        keep = ["utt", "frame_ix", "feats"]
        rows = concat_features(audio.select(*keep), ema.select(*keep))
    else:
        rows = audio if audio is not None else ema
    return rows.select(
        "utt", "frame_ix", (F.col("frame_ix") / F.lit(float(sampling_rate))).alias("time"),
        "feats",
    )

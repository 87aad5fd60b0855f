"""Feature extraction of a corpus: audio features, articulators and voicing on
one frame grid, edge silences trimmed."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelark.operators import moments as mo
from framelark.operators import phones as ph
from framelark.operators import signals as sg
from framelark.plans.corpora import CorpusAdapter
from framelark.session import cut_lineage
from framelark.sources import store

AUDIO_FORMS = ("lpc", "lsf", "mfcc")


def _positive_int(value, name: str) -> None:
    if not isinstance(value, int) or isinstance(value, bool) or value <= 0:
        raise TypeError(f"{name} must be a positive integer, not {value!r}")


def checked_arguments(
    audio_forms: str | Sequence[str] | None, n_coeff: int | Sequence[int],
    ema_sampling_rate: int, audio_frames_time: int,
) -> tuple[list[str], list[int]]:
    """Forms and one coefficient number per form."""
    _positive_int(ema_sampling_rate, "ema_sampling_rate")
    _positive_int(audio_frames_time, "audio_frames_time")
    if audio_forms is None:
        forms = list(AUDIO_FORMS)
    else:
        forms = [audio_forms] if isinstance(audio_forms, str) else list(audio_forms)
    unknown = [f for f in forms if f not in AUDIO_FORMS and f != "mfcc_"]
    if unknown:
        raise ValueError(f"unknown audio forms {unknown}")
    if isinstance(n_coeff, int):
        counts = [n_coeff] * len(forms)
    else:
        counts = list(n_coeff)
    if len(counts) != len(forms):
        raise TypeError("one coefficient number or one per form is needed")
    for count in counts:
        _positive_int(count, "n_coeff")
    return forms, counts


def extract(
    spark: SparkSession, adapter: CorpusAdapter, chart: DataFrame,
    audio_forms: str | Sequence[str] | None = None, n_coeff: int | Sequence[int] = 13,
    articulators: list[str] | None = None, ema_sampling_rate: int = 100,
    audio_frames_time: int = 25,
) -> dict[str, DataFrame]:
    """Frames per kind, trimmed to the same part of each utterance.

    The hop between audio frames is one step of the articulator grid, so all
    kinds share frame numbers. Kinds are written to the checkpoint folder once
    and then read twice: for their lengths and to be trimmed.
    """
    forms, counts = checked_arguments(
        audio_forms, n_coeff, ema_sampling_rate, audio_frames_time
    )
    wanted = list(articulators or adapter.default_articulators)
    audio = adapter.audio(spark).select("utt", "block_ix", "samples")
    kinds = {}
    for form, count in zip(forms, counts):
        kinds[form] = sg.audio_features(
            audio, form.strip("_"), adapter.audio_rate, count,
            frame_time=audio_frames_time, hop_time=1000 / ema_sampling_rate,
        )
    ema = sg.fill_gaps(adapter.ema(spark, wanted), len(wanted))
    kinds["ema"] = sg.resample(ema, adapter.ema_rate, ema_sampling_rate, len(wanted))
    phones = adapter.phones(spark)
    kinds["voicing"] = ph.voicing(
        phones, chart, ema_sampling_rate, key=adapter.name
    ).select("utt", "frame_ix", F.array("voiced").alias("feats"))
    kinds = {name: cut_lineage(frames) for name, frames in kinds.items()}
    bounds = ph.common_bounds(kinds, ph.boundaries(phones, ema_sampling_rate))
    return {name: ph.trim(frames, bounds) for name, frames in kinds.items()}


def store_extracted(kinds: dict[str, DataFrame], path: str, corpus: str) -> None:
    for name, frames in kinds.items():
        store.write_features(frames, path, corpus, name)


def normalize_kind(
    spark: SparkSession, path: str, corpus: str, kind: str, norm_type: str,
    scope: str = "corpus", width: int | None = None, mode: str = "errorifexists",
) -> str:
    """Normalise a stored kind and store the result under its norm's name.

    The width is that of the stored vectors; frames of another one fail the job.
    """
    frames = store.read_features(spark, path, corpus, kind)
    if width is None:
        width = frames.agg(F.max(F.size("feats")).alias("w")).first()["w"] or 0
    if "speaker" not in frames.columns:
        frames = frames.withColumn("speaker", F.substring_index("utt", "_", 1))
    rows = mo.normalize(frames, norm_type, scope, width).drop("speaker")
    name = mo.norm_name(norm_type, scope)
    store.write_features(rows, path, corpus, kind, name, mode)
    return name

"""Corpus adapters: where the recordings lie and how they are read.

An adapter is all that a new corpus needs: any object with these attributes
and methods works with ``extraction`` and the other plans.
"""

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelark.operators.channels import scale
from framelark.operators.filesets import adjust_provided, natural_order
from framelark.operators.signals import lowpass_filter, rms_energy
from framelark.sources import binary, text


class CorpusAdapter(Protocol):
    name: str
    speakers: list[str]
    audio_rate: int
    ema_rate: int
    default_articulators: list[str]
    lowest_limit: int
    same_speaker_data: bool

    def utterances(self, spark: SparkSession, speaker: str | None = None) -> DataFrame: ...
    def audio(self, spark: SparkSession) -> DataFrame: ...
    def ema(self, spark: SparkSession, articulators: list[str] | None) -> DataFrame: ...
    def channel_names(self, spark: SparkSession) -> list[str]: ...
    def phones(self, spark: SparkSession) -> DataFrame: ...


def _names(spark: SparkSession, path: str) -> list[str]:
    """Channel names by the first file's header; only that file is read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.ema").option(
        "recursiveFileLookup", "true").load(path)
    first = listed.agg(F.min("path").alias("path")).first()["path"]
    if first is None:
        return []
    table = binary.est_channels(spark, first).orderBy("channel")
    return [row["name"].strip() for row in table.collect()]


@dataclass(frozen=True)
class Mocha:
    """Speakers read the same list; SPHERE audio, EST tracks at 500 Hz."""

    folder: str
    name: str = "mocha"
    audio_rate: int = 16000
    ema_rate: int = 500
    lowest_limit: int = 9
    same_speaker_data: bool = True
    source_rates: tuple[int, ...] = (16000,)  # of the files; others fail the job

    # Speakers and articulators of the corpus.
    @property
    def speakers(self) -> list[str]:
        return ["fsew0", "msak0"]

    @property
    def default_articulators(self) -> list[str]:
        return [
            "tt_x", "tt_y", "td_x", "td_y", "tb_x", "tb_y", "li_x", "li_y",
            "ul_x", "ul_y", "ll_x", "ll_y", "v_x", "v_y",
        ]

    def utterances(self, spark, speaker=None):
        return text.list_utterances(spark, self.folder, ".wav", self.speakers, speaker)

    def audio(self, spark):
        raw = binary.read_audio(spark, self.folder, binary.decode_sphere)
        return binary.audio_at_rate(raw, list(self.source_rates), self.audio_rate)

    def larynx(self, spark) -> DataFrame:
        """Laryngograph energy: 200 ms frames every 2 ms, at the track's rate."""
        raw = binary.read_audio(spark, self.folder, binary.decode_sphere, ".lar")
        length, hop = self.audio_rate * 200 // 1000, self.audio_rate * 2 // 1000
        return rms_energy(raw.select("utt", "block_ix", "samples"), length, hop)

    def channel_names(self, spark):
        return [*_names(spark, self.folder), "larynx"]

    def ema(self, spark, articulators=None):
        """Tracks in centimetres, the larynx beside them if asked for, smoothed.

        The larynx is looked up only when named (or when nothing is named).
        """
        if articulators is None:
            names = self.channel_names(spark)[:-1]
        else:
            names = [a for a in articulators if a != "larynx"]
        track = binary.read_est(spark, self.folder, names=names).select("utt", "frame_ix", "feats")
        track, width = scale(track, 1 / 1000, len(names)), len(names)
        if articulators is None or "larynx" in articulators:
            energy = scale(self.larynx(spark), 10, 1).select(
                "utt", "frame_ix", F.col("feats").alias("_larynx")
            )
            track = track.join(energy, ["utt", "frame_ix"]).select(
                "utt", "frame_ix", F.concat("feats", "_larynx").alias("feats")
            )
            names, width = [*names, "larynx"], width + 1
        return _chosen(lowpass_filter(track, 20, self.ema_rate, width), names, articulators)

    def phones(self, spark):
        return text.read_mocha_labels(spark, f"{self.folder}/*/*.lab")


@dataclass(frozen=True)
class Mngu0:
    """One speaker; wav audio, EST tracks at 200 Hz, provided filesets."""

    folder: str
    name: str = "mngu0"
    audio_rate: int = 16000
    ema_rate: int = 200
    lowest_limit: int = 9
    same_speaker_data: bool = False
    source_rates: tuple[int, ...] = (16000,)

    # Articulators of the corpus.
    @property
    def default_articulators(self) -> list[str]:
        return [
            "T3_py", "T3_pz", "T2_py", "T2_pz", "T1_py", "T1_pz", "jaw_py", "jaw_pz",
            "upperlip_py", "upperlip_pz", "lowerlip_py", "lowerlip_pz",
        ]

    @property
    def speakers(self) -> list[str]:
        return []

    def utterances(self, spark, speaker=None):
        return text.list_utterances(spark, f"{self.folder}/wav_16kHz", ".wav")

    def audio(self, spark):
        raw = binary.read_audio(spark, f"{self.folder}/wav_16kHz")
        return binary.audio_at_rate(raw, list(self.source_rates), self.audio_rate)

    def channel_names(self, spark):
        return _names(spark, f"{self.folder}/ema_basic_data")

    def ema(self, spark, articulators=None):
        names = self.channel_names(spark) if articulators is None else articulators
        track = binary.read_est(spark, f"{self.folder}/ema_basic_data", names=list(names))
        return track.select("utt", "frame_ix", "feats")

    def phones(self, spark):
        return text.read_mngu0_labels(spark, f"{self.folder}/phone_labels/*.lab")

    def provided_filesets(self, spark) -> DataFrame:
        lists = text.read_fileset_lists(
            spark, f"{self.folder}/ema_filesets/*files.txt", suffix="files"
        )
        return adjust_provided(self.utterances(spark).select("utt"), lists)


@dataclass(frozen=True)
class Mspka:
    """Three speakers with texts of their own; articulators as text at 400 Hz."""

    folder: str
    name: str = "mspka"
    audio_rate: int = 22050
    ema_rate: int = 400
    lowest_limit: int = 9
    same_speaker_data: bool = False
    source_rates: tuple[int, ...] = (22050,)

    # Speakers, channels and articulators of the corpus.
    @property
    def speakers(self) -> list[str]:
        return ["cnz", "lls", "olm"]

    @property
    def default_articulators(self) -> list[str]:
        return [
            "tt_x", "tt_z", "td_x", "td_z", "tb_x", "tb_z",
            "li_x", "li_z", "ul_x", "ul_z", "ll_x", "ll_z",
        ]

    def channel_names(self, spark):
        points = ["ul", "ll", "ui", "li", "tb", "td", "tt"]
        return [f"{p}_{axis}" for p in points for axis in "xyz"]

    def utterances(self, spark, speaker=None):
        rows = text.list_utterances(
            spark, self.folder, ".lab", self.speakers, speaker
        )
        return natural_order(rows, "utt")

    def audio(self, spark):
        raw = binary.read_audio(spark, self.folder)
        return binary.audio_at_rate(raw, list(self.source_rates), self.audio_rate)

    def ema(self, spark, articulators=None):
        rows = text.read_channel_lines(spark, f"{self.folder}/*/ema_1.0.0/*.ema")
        names = self.channel_names(spark)
        return _chosen(scale(rows, 1 / 10, len(names)), names, articulators)

    def phones(self, spark):
        return text.read_mspka_labels(spark, f"{self.folder}/*/lab_1.0.0/*.lab")


def _chosen(rows: DataFrame, names: list[str], articulators: list[str] | None) -> DataFrame:
    from framelark.operators.channels import select_channels

    return rows if articulators is None else select_channels(rows, names, articulators)


def gather_audio(adapter: CorpusAdapter, spark: SparkSession, rates: list[int],
                 to_rate: int = 16000) -> DataFrame:
    """All audio of a corpus at one rate, as a table."""
    return binary.audio_at_rate(adapter.audio(spark), rates, to_rate)

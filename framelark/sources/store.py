"""The feature store: Parquet tables partitioned by corpus, kind and norm."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelark.functions.scalars import parse_feature_name

RAW = "raw"


def write_features(
    frames: DataFrame, path: str, corpus: str, kind: str, norm: str = "", mode: str = "errorifexists",
) -> None:
    """Frames of one kind under one normalisation (empty: raw).

    Each partition folder is written by itself, so others stay as they are.
    Rows are clustered by place in the recording for pruning by utterance.
    """
    folder = f"{path}/corpus={corpus}/kind={kind}/norm={norm or RAW}"
    (
        frames.repartitionByRange("utt", "frame_ix")
        .sortWithinPartitions("utt", "frame_ix")
        .write.mode(mode).parquet(folder)
    )


def read_features(
    spark: SparkSession, path: str, corpus: str, feature: str
) -> DataFrame:
    """Frames by feature name, such as ``mfcc`` or ``mfcc_stds_byspeaker``."""
    kind, norm = parse_feature_name(feature)
    rows = spark.read.option("basePath", path).parquet(f"{path}/corpus={corpus}")
    return rows.where(
        (F.col("kind") == kind) & (F.col("norm") == (norm or RAW))
    ).drop("corpus", "kind", "norm")


def write_moments(table: DataFrame, path: str, corpus: str, kind: str,
                  mode: str = "errorifexists") -> None:
    """Moments of all scopes of one kind."""
    table.write.mode(mode).partitionBy("scope").parquet(f"{path}/corpus={corpus}/kind={kind}")


def read_moments(
    spark: SparkSession, path: str, corpus: str, kind: str, scope: str = "corpus",
    speaker: str | None = None,
) -> DataFrame:
    rows = spark.read.parquet(f"{path}/corpus={corpus}/kind={kind}").where(
        F.col("scope") == scope
    )
    return rows if speaker is None else rows.where(F.col("speaker") == speaker)


def write_channels(spark: SparkSession, names: list[str], path: str, corpus: str,
                   kind: str = "ema", mode: str = "errorifexists") -> None:
    """Ordered channel names of a kind."""
    rows = [(corpus, kind, i, name.strip()) for i, name in enumerate(names)]
    spark.createDataFrame(rows, "corpus string, kind string, channel int, name string").coalesce(
        1
    ).write.mode(mode).json(f"{path}/{corpus}_{kind}")


def read_channels(spark: SparkSession, path: str, corpus: str, kind: str = "ema") -> list[str]:
    """The names in order; a channel list is as long as one vector."""
    table = spark.read.schema(
        "corpus string, kind string, channel int, name string"
    ).json(f"{path}/{corpus}_{kind}")
    return [r["name"] for r in table.orderBy("channel").collect()]


def write_timed_features(frames: DataFrame, path: str, sampling_rate: float = 100) -> None:
    """Features with their time labels; an existing path is an error."""
    rows = frames.withColumn("time", F.col("frame_ix") / F.lit(float(sampling_rate)))
    rows.select("utt", "frame_ix", "time", "feats").write.mode("errorifexists").parquet(path)

"""Inversion of utterances as their feature files arrive.

The batch job works one utterance after the other and never looks back, so the
same row-wise plan runs on a stream of files without state.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from framelark.operators.channels import keep_channels
from framelark.operators.models import DenseModel, dense_forward

FRAMES_SCHEMA = "utt string, frame_ix int, feats array<double>"


def arriving_frames(spark: SparkSession, path: str, schema: str = FRAMES_SCHEMA) -> DataFrame:
    """Normalised frames (context windows included) written below ``path``."""
    return spark.readStream.schema(schema).parquet(path)


def invert_stream(
    frames: DataFrame, model: DenseModel, destination: str, checkpoint: str,
    channels: list[int] | None = None,
) -> StreamingQuery:
    """Predict what has arrived, write it, stop; a rerun goes on from there."""
    predicted = keep_channels(dense_forward(frames, model), channels)
    return (
        predicted.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(destination)
    )

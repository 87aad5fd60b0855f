"""Inversion of a set of utterances, from files to files."""

import os

from pyspark.sql import DataFrame, SparkSession

from framelark.operators.models import DenseModel, invert
from framelark.sources import binary, text

TEXT = ".txt"


def read_source(spark: SparkSession, source: str, form: str) -> DataFrame:
    """Normalised frames out of an ark-like text, npy arrays or Parquet."""
    readers = {
        "ark": text.read_ark,
        "npy": binary.read_npy,
        "parquet": lambda s, path: s.read.parquet(path).select("utt", "frame_ix", "feats"),
    }
    if form not in readers:
        raise ValueError(f"unknown source form {form!r}; there are {sorted(readers)}")
    return readers[form](spark, source)


def run_inversion(
    spark: SparkSession, source: str, model: DenseModel, destination: str,
    width: int, source_form: str = "parquet", context: int = 0,
    keep_channels: list[int] | None = None,
) -> None:
    """Predict every utterance; ``.txt`` destinations are ark-like texts and names
    without extension Parquet tables. An existing destination is an error."""
    extension = os.path.splitext(destination.rstrip("/"))[1]
    if extension not in (TEXT, ""):
        raise TypeError("the destination must be a .txt archive or a table")
    frames = read_source(spark, source, source_form)
    predicted = invert(frames, model, width, context, keep_channels)
    if extension == TEXT:
        text.write_ark(predicted, destination)
    else:
        predicted.write.mode("errorifexists").parquet(destination)

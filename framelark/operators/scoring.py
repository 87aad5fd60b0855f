"""Scores of predictions against targets.

Predictions are rows ``(utt, frame_ix, channel, p, t)``. Nothing is padded, so
a mean over frames needs no mask.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelark.functions.scalars import cross_entropy, is_finite


def paired(predictions: DataFrame, targets: DataFrame) -> DataFrame:
    """Pair predicted and true vectors per frame and write out the channels."""
    right = targets.select("utt", "frame_ix", F.col("feats").alias("_t"))
    both = predictions.select("utt", "frame_ix", F.col("feats").alias("_p")).join(
        right, ["utt", "frame_ix"]
    )
    cells = F.posexplode(F.arrays_zip(F.col("_p").alias("p"), F.col("_t").alias("t")))
    return both.select("utt", "frame_ix", cells.alias("channel", "_c")).select(
        "utt", "frame_ix", "channel", F.col("_c.p").alias("p"), F.col("_c.t").alias("t")
    )


def _square_error() -> Column:
    gap = F.col("p") - F.col("t")
    return gap * gap


def rmse(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scored.groupBy(*keys).agg(F.sqrt(F.avg(_square_error())).alias("rmse"))


def rmse_utterance(scored: DataFrame) -> DataFrame:
    return rmse(scored, ["utt", "channel"])


def score_corpus(
    scored: DataFrame, binary: Sequence[int] = (), max_length: int | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Corpus score per channel: RMSE, or mean cross-entropy if binary.

    Pooling all frames equals the length-weighted mean of utterance scores.
    A fixed maximum length cuts every utterance first.
    """
    rows = scored if max_length is None else scored.where(F.col("frame_ix") < max_length)
    is_binary = F.col("channel").isin(list(binary)) if binary else F.lit(False)
    loss = F.when(is_binary, cross_entropy(F.col("p"), F.col("t"))).otherwise(_square_error())
    table = rows.groupBy(*keys, "channel").agg(
        F.avg(loss).alias("_loss"), F.count(F.lit(1)).alias("n")
    )
    score = F.when(is_binary, F.col("_loss")).otherwise(F.sqrt(F.col("_loss")))
    return table.select(*keys, "channel", score.alias("score"), "n")


def score_blocks(scored: DataFrame, n_channels: int, n_input: int) -> DataFrame:
    """Corpus scores in two blocks: targets first, rebuilt inputs last."""
    block = F.when(F.col("channel") < n_channels - n_input, "encoder").otherwise("decoder")
    return score_corpus(scored.withColumn("block", block), keys=["block"])


def binary_scores(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy of rounded probabilities ``p`` and cross-entropy against ``t``."""
    hit = F.when(F.rint("p") == F.col("t"), 1.0).otherwise(0.0)
    return rows.groupBy(*keys).agg(
        F.avg(hit).alias("accuracy"),
        F.avg(cross_entropy(F.col("p"), F.col("t"))).alias("cross_entropy"),
        F.count(F.lit(1)).alias("n"),
    )


def sequence_scores(rows: DataFrame, sequence: str = "utt") -> DataFrame:
    """Binary scores of sequences, each judged by its mean frame probability."""
    means = rows.groupBy(sequence).agg(F.avg("p").alias("p"), F.first("t").alias("t"))
    return binary_scores(means)


def finite_mean(rows: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over the finite values only."""
    x = F.col(column)
    return rows.groupBy(*keys).agg(F.avg(F.when(is_finite(x), x)).alias("mean"))


def mean_log_likelihood(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean log-density per key; over the corpus it weighs by length."""
    return rows.groupBy(*keys).agg(
        F.avg(F.ln(F.col("density") + F.lit(1e-62))).alias("log_likelihood"),
        F.count(F.lit(1)).alias("n"),
    )

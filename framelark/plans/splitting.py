"""The covering split of a corpus, by its own defaults, as a stored table."""

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelark.operators.filesets import (
    generalize_to_speakers, same_speaker_rank, split_corpus,
)
from framelark.operators.frames import salted_join
from framelark.operators.phones import triphones
from framelark.plans.corpora import CorpusAdapter
from framelark.session import cut_lineage
from framelark.sources.text import write_filesets


def split_utterances(
    corpus: CorpusAdapter, utterances: DataFrame, phones: DataFrame, pct_train: float = 0.7,
    limit: int | None = None, seed: int = 0,
) -> DataFrame:
    """``(utt, set_name)`` of all utterances ``(speaker, utt)`` of a corpus.

    ``limit`` defaults to the corpus's own; a lower one is allowed but likely to
    fail. Where all speakers read one list, the list is split by the first
    speaker's recordings, and the i-th utterance of every speaker follows.
    """
    limit = corpus.lowest_limit if limit is None else limit
    if limit < corpus.lowest_limit:
        warnings.warn(f"a limit below {corpus.lowest_limit} is likely to fail", stacklevel=2)
    index = triphones(phones).select("utt", "triphone")
    if not corpus.same_speaker_data:
        return split_corpus(index, utterances, pct_train, limit, seed)
    ranks = cut_lineage(same_speaker_rank(utterances.select("speaker", "utt")))
    first = ranks.where(F.col("speaker") == corpus.speakers[0]).select("utt", "rank")
    by_rank = salted_join(index, first, ["utt"], spread=F.col("triphone")).select(
        F.col("rank").alias("utt"), "triphone")
    sets = split_corpus(by_rank, first.select(F.col("rank").alias("utt")), pct_train, limit, seed)
    return generalize_to_speakers(sets.withColumnRenamed("utt", "rank"), ranks).select("utt", "set_name")


def split_to_store(
    spark: SparkSession, corpus: CorpusAdapter, path: str, pct_train: float = 0.7,
    limit: int | None = None, seed: int = 0,
) -> None:
    """Split a corpus from its files and write the name lists of its sets."""
    sets = split_utterances(
        corpus, corpus.utterances(spark), corpus.phones(spark), pct_train, limit, seed)
    write_filesets(sets, path)

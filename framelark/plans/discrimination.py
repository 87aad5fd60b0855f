"""ABX discrimination of a corpus from its phones, chart and features."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelark.operators import abx
from framelark.operators import phones as ph
from framelark.operators.filesets import in_fileset


def make_items(
    phones: DataFrame, chart: DataFrame, corpus: str, limit_phones: bool = False,
    filesets: DataFrame | None = None, fileset: str | None = None,
) -> DataFrame:
    """Items of a fileset (of all utterances, when none is named) in the symbols
    common to all corpora, or in the reduced set of them."""
    if fileset is not None:
        phones = in_fileset(phones, filesets, fileset)
    if "speaker" not in phones.columns:
        phones = phones.withColumn("speaker", F.substring_index("utt", "_", 1))
    target = "common_reduced" if limit_phones else "common"
    return ph.items(ph.map_symbols(phones, chart, target, key=corpus))


def abx_from_features(
    features: DataFrame, items: DataFrame, chart: DataFrame, width: int,
    by_speaker: bool = True, sampling_rate: float = 100, ipa: bool = True,
) -> DataFrame:
    """Scores per phone pair and cell, phones written in IPA where the chart has it."""
    by = abx.BY_SPEAKER if by_speaker else abx.BY_CONTEXT
    scores = abx.abx_scores(abx.tokens(items, features, sampling_rate), width, by)
    if not ipa:
        return scores
    for column in ("phone_1", "phone_2"):
        scores = ph.map_symbols_or_null(scores, chart, column, "common", "ipa")
    return scores

from dataclasses import dataclass

import numpy as np
import pytest

from framelark.operators import filesets as fs
from framelark.plans.splitting import split_to_store, split_utterances
from framelark.sources.text import read_filesets


@dataclass
class Corpus:
    """Two speakers read the same list, the second one with slips of the tongue."""

    table: object
    same_speaker_data: bool
    lowest_limit: int = 4
    speakers: tuple = ("s1", "s2")

    def utterances(self, spark, speaker=None):
        return self.table.select("speaker", "utt").distinct()

    def phones(self, spark):
        return self.table.select("utt", "phone_ix", "t_end", "symbol")


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(40):
        symbols = rng.choice(list("abc"), 6)
        for s, extra in (("s1", ""), ("s2", "x")):
            rows += [(s, f"{s}_{i:02d}", k, (k + 1) / 10, c + (extra if k == 0 else ""))
                     for k, c in enumerate(symbols)]
    return spark.createDataFrame(
        rows, "speaker string, utt string, phone_ix int, t_end double, symbol string").persist()


def covered(spark, corpus, sets, limit):
    from framelark.operators.phones import triphones

    index = triphones(corpus.phones(spark)).select("utt", "triphone")
    return fs.uncovered(fs.with_set(fs.kept_index(index, limit), sets)).count() == 0


def test_lists_read_by_all_speakers(spark, table, tmp_path):
    corpus = Corpus(table, True)
    split_to_store(spark, corpus, f"{tmp_path}/sets", 0.6, seed=1)
    sets = read_filesets(spark, f"{tmp_path}/sets")
    names = {r["utt"]: r["set_name"] for r in sets.collect()}
    assert len(names) == 80
    assert all(names[f"s1_{i:02d}"] == names[f"s2_{i:02d}"] for i in range(40))
    want = fs.target_sizes(40, 0.6)
    assert {s: list(names.values()).count(s) for s in fs.SETS} == {s: 2 * n for s, n in want.items()}
    one = Corpus(table.where("speaker = 's1'"), True)
    assert covered(spark, one, sets.where("utt like 's1%'"), 4)


def test_lists_of_their_own_and_limits(spark, table):
    corpus = Corpus(table, False)
    sets = split_utterances(corpus, corpus.utterances(spark), corpus.phones(spark), 0.5, seed=2)
    assert sets.count() == 80 and covered(spark, corpus, sets, 4)
    with pytest.warns(UserWarning, match="below 4"), pytest.raises(ValueError):
        split_utterances(corpus, corpus.utterances(spark), corpus.phones(spark), limit=2)

import os
import time
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelark.operators import filesets as fs
from framelark.operators.exchange import covers, even_out, exchanges, leavers


@pytest.fixture(scope="module")
def index(spark):
    rng = np.random.default_rng(2)
    rows = []
    for u in range(300):
        rows += [(u, f"t{t}") for t in set(rng.zipf(1.4, size=25)) if t < 400]
    rows += [(u, "common") for u in range(300)]
    return spark.createDataFrame(rows, "utt int, triphone string").distinct().persist()


@pytest.fixture(scope="module")
def utterances(spark):
    # Some utterances have no triphone at all.
    return spark.range(320).select(F.col("id").cast("int").alias("utt"))


@pytest.mark.parametrize("pct, seed", [(0.7, 1), (0.5, 2)])
def test_contract(spark, index, utterances, pct, seed):
    sets = fs.split_corpus(index, utterances, pct, limit=9, seed=seed).persist()
    names = {r["utt"]: r["set_name"] for r in sets.collect()}
    assert len(names) == sets.count() == 320
    want = fs.target_sizes(320, pct)
    assert {s: list(names.values()).count(s) for s in fs.SETS} == want
    kept = fs.kept_index(index, 9)
    assert fs.uncovered(fs.with_set(kept, sets)).count() == 0
    assert kept.select("triphone").distinct().count() > 10


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = blocks.getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}


def test_rounds_leave_no_files(spark, index, utterances):
    """What a round wrote goes when the next one has been written, on disk and in the shuffles."""
    index.count()
    fs.staged(spark.range(1))
    folder = urllib.parse.urlparse(spark.sparkContext._jsc.sc().getCheckpointDir().get()).path
    before, shuffled = set(os.listdir(folder)), shuffle_files(spark)
    sets = fs.split_corpus(index, utterances, 0.7, limit=9, seed=1)
    left = set(os.listdir(folder)) - before
    assert len(left) <= 5  # document frequencies, utterances, the index by number, the sets
    fs.staged(sets.limit(1))
    until = time.time() + 3
    while shuffle_files(spark) - shuffled and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - shuffled


def test_reproducible_and_seeded(index, utterances):
    one, same, other = (
        {tuple(r) for r in fs.split_corpus(index, utterances, seed=s).collect()} for s in (1, 1, 2)
    )
    assert one == same and one != other


def test_impossible_cover_is_an_error(spark):
    rows = [(u, f"t{t}") for u in range(4) for t in range(20)]
    index = spark.createDataFrame(rows, "utt int, triphone string")
    utts = spark.range(40).select(F.col("id").cast("int").alias("utt"))
    fine = fs.split_corpus(index, utts, limit=3)
    assert fs.uncovered(fs.with_set(fs.kept_index(index, 3), fine)).count() == 0
    with pytest.raises(RuntimeError):
        fs.split_corpus(index.where("utt < 3"), utts.where("utt < 3"), pct_train=0.9, limit=3)


def test_argument_errors(index, utterances):
    for bad in (0.0, 1.0, 70):
        with pytest.raises(ValueError):
            fs.split_corpus(index, utterances, pct_train=bad)
    with pytest.raises(ValueError):
        fs.split_corpus(index, utterances, limit=2)


def test_target_sizes():
    assert fs.target_sizes(10, 0.7) == {"train": 7, "validation": 1, "test": 2}
    assert sum(fs.target_sizes(1001, 0.61).values()) == 1001


def test_movable_by_hand(spark):
    sets = spark.createDataFrame([(1, "train"), (2, "train"), (3, "test")], "utt int, set_name string")
    index = spark.createDataFrame(
        [(1, "a"), (2, "a"), (2, "b"), (3, "a")], "utt int, triphone string"
    )
    got = {r["utt"]: r["movable"] for r in fs.movable(fs.with_set(index, sets)).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_names(spark):
    utts = spark.createDataFrame([("ab12c",), ("12",), ("13f",), ("g12",)], "utt string")
    lists = spark.createDataFrame([("12", "train"), ("13", "test")], "utt string, set_name string")
    got = {tuple(r) for r in fs.adjust_provided(utts, lists).collect()}
    assert got == {("ab12c", "train_initial"), ("12", "train_initial"), ("13f", "test_initial")}
    names = ["u10", "u9", "u1a2", "u1a10", "u", "u000000000000000000000000000011"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    order = [r["n"] for r in fs.natural_order(rows, "n").collect()]
    assert order == ["u", "u1a2", "u1a10", "u9", "u10", "u000000000000000000000000000011"]


def test_seeded_draws_ignore_partitioning(spark):
    rows = spark.range(50).select(F.col("id").cast("string").alias("utt"))
    a = [r["utt"] for r in fs.mini_batch(rows.repartition(7), 5, 1).collect()]
    b = [r["utt"] for r in fs.mini_batch(rows.coalesce(1), 5, 1).collect()]
    assert a == b and len(a) == 5


def tight(seed):
    """Groups of equal utterances, which bind small sets, and richer ones that tempt."""
    rng = np.random.default_rng(seed)
    rows = [(u, f"t{4 * (u % 12) + i}") for u in range(200) for i in range(4)]
    return rows + [
        (u, f"t{t}") for u in range(200, 230) for t in rng.choice(48, 6, replace=False)]


def test_small_sets_that_need_exchanges(spark, seed=4):
    index = spark.createDataFrame(tight(seed), "utt int, triphone string")
    utts = spark.range(230).select(F.col("id").cast("int").alias("utt"))
    sets = fs.split_corpus(index, utts, 0.82, limit=9, seed=seed)
    names = {r["utt"]: r["set_name"] for r in sets.collect()}
    assert {s: list(names.values()).count(s) for s in fs.SETS} == fs.target_sizes(230, 0.82)
    assert fs.uncovered(fs.with_set(fs.kept_index(index, 9), sets)).count() == 0


def test_exchange_by_hand(spark):
    """1 and 2 are bound to test; 3 has all that binds them and is bound at home
    by what 2 brings; 4 frees 1 alone."""
    rows = {1: "ab", 2: "cd", 3: "abcd", 4: "ab", 5: "ab", 6: "c", 7: "abcd"}
    home = {1: "test", 2: "test", 3: "train", 4: "train", 5: "train", 6: "train", 7: "validation"}
    kept = spark.createDataFrame([(u, t) for u, ts in rows.items() for t in ts], "utt int, triphone string")
    sets = spark.createDataFrame(
        [(u, len(rows[u]), u * 10, s) for u, s in home.items()],
        "utt int, n_tri int, draw long, set_name string")
    free = leavers(kept, sets, F.lit(True))
    assert {r["utt"] for r in free.collect()} == {4, 5, 6}
    got = {tuple(r) for r in exchanges(kept, sets, "test", [7]).collect()}
    assert got == {(3, "train", 1), (3, "train", 2)}
    done = even_out(kept, sets, {"train": 5, "validation": 1, "test": 1}, 1, 20)
    names = {r["utt"]: r["set_name"] for r in done.collect()}
    assert sorted(names.values()) == ["test"] + ["train"] * 5 + ["validation"]
    assert covers(kept, done, list(fs.SETS))

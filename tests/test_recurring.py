import numpy as np
import pytest
from pyspark.sql import functions as F

from framelark.functions import kernels
from framelark.operators import exchange
from framelark.operators import filesets as fs
from framelark.operators import phones as ph

SEPARATORS = " \t\n\r"


def texts_of(n=300, seed=3):
    """Texts of a few common words and many rare ones, with odd gaps, repeats and empty rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(n):
        words = [f"w{v}" if v < 12 else f"ż{u}_{v}" for v in rng.zipf(1.5, size=int(rng.integers(0, 60)))]
        gaps = rng.choice([" ", "  ", "\n", "\t \r"], size=len(words) + 1)
        rows.append((u, "".join(g + w for g, w in zip(gaps, words)) + str(gaps[-1])))
    return rows + [(n, None), (n + 1, ""), (n + 2, "a b"), (n + 3, "one\vtwo three\ffour five"),
                   (None, "w1 w1 w1 w1"), (0, "w1 w1 w1 w2 w1")]


@pytest.fixture(scope="module")
def tables(spark):
    texts = spark.createDataFrame(texts_of(), "utt long, text string").repartition(5)
    tokens = F.split(F.btrim("text", F.lit(SEPARATORS)), f"[{SEPARATORS}]+")
    return texts, texts.select("utt", tokens.alias("tokens"))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("slice_bytes, place_bits", [(4 << 20, 26), (500, 26), (500, 7)])
def test_keeps_what_the_whole_index_keeps(tables, monkeypatch, slice_bytes, place_bits):
    monkeypatch.setattr(ph, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(ph, "PLACE_BITS", place_bits)
    texts, tokens = tables
    whole = ph.token_triphones(tokens, " ")
    part = ph.recurring_triphones(texts, 9, " ")
    assert rows_of(fs.kept_index(part, 9)) == rows_of(fs.kept_index(whole, 9))
    assert rows_of(fs.document_frequency(part, 9)) == rows_of(fs.document_frequency(whole, 9))
    assert not set(rows_of(part)) - set(rows_of(whole))


def test_leaves_out_what_does_not_recur(tables):
    texts, tokens = tables
    whole, part = (set(rows_of(d)) for d in (
        ph.token_triphones(tokens, " "), ph.recurring_triphones(texts, 9, " ")))
    assert len(part) < len(whole) / 2


def test_equal_strings_have_equal_hashes():
    def hashes(words):
        data = np.frombuffer("".join(words).encode(), np.uint8)
        return kernels.trigram_hashes(data, np.cumsum([0] + [len(w.encode()) for w in words]), "_").tolist()

    words = ["a", "bb", "ż", "a", "bb", "x" * 50, "a"]
    assert hashes(["first", *words])[1:] == hashes(words)
    assert hashes(["a_b", "c", "d"]) == hashes(["a", "b_c", "d"])
    assert len(set(hashes(words))) == 5 and hashes(words[:2]) == []


def test_hot_triphones_are_dealt_out(spark, monkeypatch):
    """Hot or not, the kept rows are the same, rows of a NULL utterance included."""
    rows = [(u, "hot") for u in [*range(200), None]] + [(u, f"t{u % 20}") for u in range(200)]
    index = spark.createDataFrame(rows + [(1, "rare")], "utt long, triphone string")
    plain = rows_of(fs.kept_index(index, 9))
    monkeypatch.setattr(fs, "HOT", 50)
    assert rows_of(fs.kept_index(index, 9)) == plain == rows_of(index.where("triphone != 'rare'"))


def test_placed_index_stays_in_place(spark, monkeypatch):
    """A round joins the sets to the index without moving the index; hot utterances too."""
    rows = [(u, t) for u in range(40) for t in range(u % 7, 60, 3)] + [(None, 1)]
    kept = spark.createDataFrame(rows, "utt long, triphone long")
    rich = kept.groupBy("utt").agg(F.count(F.lit(1)).alias("n_tri"))
    sets = rich.where("utt is not null").withColumn("set_name", F.lit("train"))
    want = rows_of(exchange.indexed(kept, sets).select("utt", "triphone", "set_name"))
    monkeypatch.setattr(exchange, "HOT", 18)
    joined = exchange.indexed(exchange.placed(kept, rich), sets.hint("merge"))
    assert rows_of(joined.select("utt", "triphone", "set_name")) == want
    plan = joined._jdf.queryExecution().executedPlan().toString()
    index_side = plan.split("SortMergeJoin")[1].split("Scan ExistingRDD")[0]
    assert "Exchange" not in index_side and "Sort [" not in index_side

"""Stages keep columns whose names an operator uses itself, or that need quotes."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framelark.llm.overlap_join import one_of_each
from framelark.llm.spaced_seeds import decontaminate

ODD = ["a.b", "_key", "_row", "_host", "_copy", "kept", "size", "taken", "h", "key", "node", "c0", "q`t"]
TEXT = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen "


@pytest.fixture(scope="module")
def odd(spark):
    texts = [TEXT, TEXT, TEXT + "fifteen", None, "", "x y z " * 20_000, "some other words in a row here"]
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), *[f"{n}-{i}" for n in ODD]) for i, t in enumerate(texts)]
    names = ["doc_id", "text", "lang", "source", "n_chars", *ODD]
    return spark.createDataFrame(rows, ["k%d" % i for i in range(len(names))]).toDF(*names)


def check(df, ids):
    rows = df.collect()
    assert {r[0] for r in rows} == ids
    for r in rows:
        assert list(r[5:5 + len(ODD)]) == [f"{n}-{r[0]}" for n in ODD]


def test_one_of_each_and_decontaminate(spark, odd):
    kept = one_of_each(odd)
    assert kept.columns == odd.columns
    check(kept, {0, 3, 4, 5, 6})
    bench = spark.createDataFrame([(1, TEXT)], "item_id long, text string")
    clean = decontaminate(odd, bench)
    assert clean.columns == odd.columns
    check(clean, {3, 4, 5, 6})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, odd, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, odd, "/root/testdata/sf0.001")
    added = ["shard", "slot"] if name == "sharding" else []
    assert out.columns == [*odd.columns, *added]
    rows = out.select(F.struct("*").alias("r")).collect()
    assert rows
    for (r,) in rows:
        assert list(r[5:5 + len(ODD)]) == [f"{n}-{r[0]}" for n in ODD]

"""Token attribution and rule verdicts against plain Python."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from framelark.llm import isolation_rules as rules
from framelark.llm.token_attribution import VOCABULARY, attribute, encode, encoder, token_counts

SMALL = "/root/testdata/sf0.001"


def texts_of(n=60):
    return [r[0] for r in duckdb.sql(
        f"select text from '{SMALL}/documents.parquet' order by doc_id limit {n}").fetchall()]


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1
           for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))


ODD = [None, "", " \n\t", "a", "a\n\na\n \n a\na", "x y z " * 40, "ä ö ß # | \x0b<",
       "w" * 30_000, "one two three four five " * 2, "Lang\n" * 7]


def test_rule_counts(make_docs, spark):
    texts = texts_of() + ODD
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    docs = make_docs(texts).withColumn("kept", F.lit("clash"))
    got = {r.doc_id: r for r in rules.quality_rules(docs, labels).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r, want = got[i], brute_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert (r.base_failed, r.kept) == (failed, not failed)  # one kind of label


def brute_path(x, forest, t, node=0, level=0):
    feature, cut, path = forest
    depth = int(np.log2(feature.shape[1] + 1)) - 1
    if level == depth:
        return path[t, node]
    right = x[feature[t, node]] >= cut[t, node]
    return brute_path(x, forest, t, 2 * node + 1 + right, level + 1)


def test_forest_sets_outliers_apart():
    draw = np.random.default_rng(0)
    x = np.concatenate([draw.normal(0, 1, (500, 4)), [[9, 9, 9, 9]], np.zeros((3, 4))])
    forest = rules.grow(x, 1)
    score = rules.anomaly(x, forest)
    assert score.argmax() == 500 and score[500] > 0.7
    paths = [np.mean([brute_path(row, forest, t) for t in range(100)]) for row in x[495:]]
    assert np.allclose(score[495:], 2.0 ** (-np.array(paths) / rules.search_length(256)))
    same = rules.anomaly(np.ones((5, 4)), rules.grow(np.ones((5, 4)), 1))
    assert len(set(same)) == 1


def test_calibration_keeps_the_good():
    score = np.array([.1, .2, .3, .4, .5, .6, .7, .8])
    good = np.array([1, 1, 1, 0, 1, 0, 0, 0], bool)
    assert rules.calibrate(score, good, 0.0) == .5
    assert rules.calibrate(score, good, 0.25) == .3
    assert rules.calibrate(score, np.ones(8, bool), 0.5) == np.inf


def test_verdicts_on_labelled_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = rules.quality_rules(docs, labels).join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.3


def test_all_labelled_rows_make_the_verdicts(spark):
    n = 21_000
    draw = np.random.default_rng(2)
    words = draw.integers(0, 900, (n, 12))
    odd = draw.random(n) < 0.01
    texts = [" ".join((f"W{w}#" if o else "w" * (w % 9 + 1) + str(w)) for w in row) for row, o in zip(words, odd)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    quality = np.where(odd, draw.random(n) < 0.2, draw.random(n) < 0.95).astype(int)
    labels = spark.createDataFrame(list(enumerate(quality.tolist())), "doc_id long, quality int")
    rows = sorted(rules.quality_rules(docs, labels, tolerated=0.01, lost=0.05).collect())
    counts = np.array([r[1:1 + len(rules.COUNTS)] for r in rows])
    assert not any(r.base_failed for r in rows)
    order = np.argsort([int(hashlib.md5(f"5:{i}".encode()).hexdigest()[:15], 16) for i in range(n)])
    x, good = rules.shares(counts), quality > 0
    limits = rules.usual(x[good], 0.01)
    x = rules.excess(x, limits)
    score = rules.anomaly(x, rules.grow(x[order], 5))
    assert [r.anomaly for r in rows] == score.tolist()
    assert [r.kept for r in rows] == (score <= rules.calibrate(score, good, 0.05)).tolist()


def test_sums_over_weighed_rows_equal_those_over_all(spark):
    draw = np.random.default_rng(4)
    values, n = draw.integers(0, 50, (3_000, rules.STATISTICS)) / 7, draw.integers(1, 30, 3_000)
    rows = spark.createDataFrame(
        [(v.tolist(), int(k)) for v, k in zip(values, n)], "values array<double>, n long").repartition(5)
    for tolerated in (0.0, 0.001, 0.3):
        want = rules.usual(np.repeat(values, n, axis=0), tolerated)
        assert rules.usual_of(rows, int(n.sum()), tolerated).tolist() == want.tolist()
    score, good = draw.integers(1, 40, 3_000) / 41, draw.random(3_000) < 0.5
    rows = spark.createDataFrame(
        [(float(s), int(k * g), int(k * (not g))) for s, k, g in zip(score, n, good)],
        "score double, good long, bad long")
    for lost in (0.0, 0.1, 0.6):
        want = rules.calibrate(np.repeat(score, n), np.repeat(good, n), lost)
        assert rules.calibrated(rows, int(n[good].sum()), int(n[~good].sum()), lost) == want


def test_trees_draw_from_all_rows(spark, monkeypatch):
    monkeypatch.setattr(rules, "TREES", 5)
    monkeypatch.setattr(rules, "SUBSAMPLE", 40)
    n = 900
    rows = spark.createDataFrame(
        [((i << 50) + i, *[i] * len(rules.COUNTS), 1 + i % 2, True, [float(i)] * rules.STATISTICS)
         for i in range(n)],
        "place long, " + ", ".join(f"{c} long" for c in rules.COUNTS) + ", n long, good boolean, values array<double>")
    whole = np.repeat(np.arange(n), 1 + np.arange(n) % 2)
    x, drawn = rules.forest_rows(rows, len(whole), 3)
    draw = np.random.Generator(np.random.PCG64(3))
    for tree in drawn:
        assert x[tree, 0].tolist() == whole[draw.choice(len(whole), 40, replace=False)].tolist()
    few, drawn = rules.forest_rows(rows.where("n_words < 100"), 150, 3)
    assert drawn is None and few[:, 2].tolist() == whole[:150].tolist()


def test_rules_of_nothing(make_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert rules.quality_rules(make_docs(["a"]).where("false"), none).count() == 0
    twice = rules.quality_rules(make_docs([(1, "a " * 20), (1, "a " * 20), (None, "b")]), none)
    assert sorted(r.n_words for r in twice.collect()) == [1, 20, 20]


def brute_owner(start, end, spans, rule):
    held = [max(0, min(end, b) - max(start, a)) for a, b in spans]
    if rule == "start":
        return {next(i for i, h in enumerate(held) if h): 1.0}
    if rule == "most":
        return {held.index(max(held)): 1.0}
    return {i: h / (end - start) for i, h in enumerate(held) if h}


@pytest.mark.parametrize("rule", ["start", "most", "share"])
def test_attribution_of_random_spans(rule):
    draw = np.random.default_rng(3)
    for _ in range(40):
        ends = np.cumsum(draw.integers(1, 6, 30))
        starts = np.concatenate(([0], np.sort(draw.integers(0, ends[-1] + 1, 12))))
        spans = list(zip(starts, np.append(starts[1:], ends[-1])))
        want = np.zeros(len(starts))
        for a, b in zip(np.concatenate(([0], ends[:-1])), ends):
            for i, share in brute_owner(a, b, spans, rule).items():
                want[i] += share
        assert np.allclose(attribute(ends, starts, rule)[0], want)


def test_tokens_equal_another_tokenizer(make_docs):
    """Character offsets of an independent encoder of the same vocabulary."""
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    texts = texts_of(25) + ["", None, "a\n\n b  c", "ß |\n"]
    rows = {}
    for r in token_counts(make_docs(texts), rule="start").collect():
        rows.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(texts):
        whole = f"en\nsrc{i % 3}\n{text or ''}"
        found = other.encode(whole, add_special_tokens=False)
        mine = sorted(rows[i], key=lambda r: (r.start_byte, r.end_byte, r.section))
        assert sum(r.n_tokens for r in mine) == len(found.ids) == mine[0].doc_tokens
        assert mine[-1].end_byte == len(whole.encode())
        if whole.isascii():
            begin = [whole[a:b] and a for a, b in found.offsets]
            for r in mine:
                assert r.n_tokens == sum(r.start_byte <= a < r.end_byte for a in begin)


def test_long_runs_of_white_space():
    with open(VOCABULARY, "rb") as file:
        own, lengths = encoder(file.read())
    for gap in (" " * 5000, "\n" * 5000, " \n" * 3000 + "\t"):
        for text in (f"ab{gap}cd", gap, f"{gap}x", f"x{gap}", f"a{gap}b{gap}"):
            assert encode(own, text).tolist() == own.encode_ordinary(text)
    assert lengths[encode(own, " " * 1_000_000 + "x")].sum() == 1_000_001


def test_token_counts_of_nothing(make_docs):
    assert token_counts(make_docs(["a"]).where("false")).count() == 0
    docs = make_docs([(1, None), (1, None)]).withColumn("lang", F.lit(None).cast("string"))
    rows = token_counts(docs.withColumn("n_tokens", F.lit("clash")), ["lang"], ["doc_id", "n_tokens"])
    assert [r.n_tokens for r in rows.collect()] == [0.0, 0.0]

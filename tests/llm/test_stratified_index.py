import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from framelark.llm.stratified_index import (
    Queries, _Best, _Block, _search_block, _unpack, build_index, normaliser, ranked_search, search,
)


def words(text):
    lowered = re.sub("[A-Z]", lambda c: c.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, k=20):
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [(i, bag) for i, bag in bags if bag]
    n_docs, total = len(bags), sum(sum(bag.values()) for _, bag in bags)
    df = Counter(w for _, bag in bags for w in bag)
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            m = 100 - 25 + (25 * sum(bag.values()) * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                * ((10**9 * bag[w]) // (1000 * bag[w] + 12 * m))
                for w in words(text) if w in bag)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def rows(df):
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()], key=repr)


ITEMS = "item_id long, text string"


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(3)
    names = [f"w{i}" for i in range(60)] + ["Été", "über-x", "Σ1"]
    heavy = [1 / (i + 1) for i in range(len(names))]
    docs = [(i, " ".join(draw.choices(names, heavy, k=draw.choice([1, 3, 3, 12, 40])))) for i in range(300)]
    docs += [(1000 + i, docs[i % 3][1]) for i in range(150)]  # ties beyond k
    items = [(i, " ".join(draw.choices(names, k=draw.choice([1, 5, 20])))) for i in range(17)]
    return docs, items


@pytest.mark.parametrize("block_docs, query_rows", [(10_000, 500), (7, 9)])
def test_equals_brute_force(spark, make_docs, corpus, block_docs, query_rows):
    docs, items = corpus
    index = build_index(make_docs(docs), block_docs=block_docs)
    got = search(index, spark.createDataFrame(items, ITEMS), query_rows=query_rows)
    assert rows(got) == brute(docs, items)


def test_nulls_empty_long_and_repeated(spark, make_docs):
    long = "apple " * 60_000 + "pear"
    docs = [(5, "Apple pear"), (5, "Apple pear"), (None, "apple pear"), (2, None), (3, ""), (4, "?! .."),
            (9, long), (8, "pear,apple;APPLE"), (7, "kiwi")]
    items = [(1, "apple apple pear"), (1, "apple apple pear"), (2, None), (3, "..."), (None, "Kiwi"), (6, "plum")]
    got = ranked_search(make_docs(docs), spark.createDataFrame(items, ITEMS))
    assert rows(got) == brute(docs, [items[0], *items[2:]])


def test_empty_tables_and_clashing_names(spark, make_docs):
    items = spark.createDataFrame([(1, "a")], ITEMS)
    assert ranked_search(make_docs([]), items).count() == 0
    assert ranked_search(make_docs([None, "-"]), items).count() == 0
    assert ranked_search(make_docs(["a"]), items.limit(0)).count() == 0
    docs = make_docs(["a b", "b"]).selectExpr("doc_id as `a.b`", "text as key", "1 as text", "2 as ids")
    odd = spark.createDataFrame([(1, "b", 3)], "`item.x` long, `te``xt` string, query int")
    got = ranked_search(docs, odd, "a.b", "key", "item.x", "te`xt")
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert [r[2] for r in rows(got)] == [1, 0]


def test_scores_beyond_exact_doubles():
    """Sums of 2**53 and more are added in integers."""
    block = _Block()
    for i, text in enumerate([b"x y", b"x z", b"other"]):
        block.add(i, text, text.split())
    weights = np.array([2**40 + 1, 2**40 + 3])
    queries = Queries({"x": 0, "y": 1}, np.array([0, 2]), np.array([0, 1]), weights)
    best = _Best(1, 20)
    _search_block(_unpack(block.row(3, 5), 0), queries, best)
    impact = 10**9 // (1000 + 12 * normaliser(2, 3, 5))
    assert sorted(zip(best.rows[1].tolist(), best.rows[2].tolist())) == [
        (impact * (2**40 + 1), 1), (impact * (2**41 + 4), 0)]

"""Spaced seeds against a comparison of all aligned windows."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from framelark.llm import spaced_seeds as seeds


def tokens(text):
    return [t for t in re.split(r"[^\w]+", (text or "").lower().replace("_", " ")) if t]


def runs(t):
    return {tuple(t[i:i + 4]) for i in range(len(t) - 3)}


def brute(docs, items, window=13, subs=2):
    out = {}
    docs = [(d, tokens(text)) for d, text in docs]
    items = [(b, tokens(item)) for b, item in items]
    own = {b: runs(u) for b, u in items}
    for (d, t), (b, u) in itertools.product([(d, (t, runs(t))) for d, t in docs], items):
        t, grams = t
        w = window if len(u) >= window else len(u)
        # Two substitutions in 13 tokens leave four equal ones in a row.
        if len(u) < seeds.LEAST_TOKENS or not grams & own[b]:
            continue
        for i in range(len(t) - w + 1):
            same = max((sum(x == y for x, y in zip(t[i:i + w], u[j:j + w]))
                        for j in range(len(u) - w + 1)), default=0)
            if same >= w - (subs if w == window else 0):
                n, best = out.get((d, b), (0, 0))
                out[d, b] = (n + 1, max(best, same))
    return out


def test_masks_miss_no_two_substitutions():
    for pair in itertools.combinations(range(13), 2):
        assert any(
            all(not (o <= p < o + len(m) and m[p - o] == "1") for p in pair)
            for m in seeds.MASKS for o in range(13 - len(m) + 1)
        ), pair


@pytest.fixture(scope="module")
def cases():
    draw = random.Random(7)
    word = lambda: f"w{draw.randrange(60)}"
    items = [(b, " ".join(word() for _ in range(n)))
             for b, n in enumerate([13, 14, 20, 40, 7, 12, 5, 4, 1])]
    items += [(20, None), (21, ""), (22, items[0][1])]
    docs = []
    for d in range(60):
        text = [word() for _ in range(draw.randrange(0, 60))]
        part = items[draw.randrange(7)][1].split()
        a = draw.randrange(max(1, len(part) - 13))
        part = part[a:a + draw.randrange(10, 30)]
        for _ in range(draw.randrange(4)):
            part[draw.randrange(len(part))] = "other"
        at = draw.randrange(len(text) + 1)
        docs.append((d, " ".join(text[:at] + part + text[at:]).title() + "!"))
    return docs + [(90, None), (91, ""), (92, items[2][1] * 1), (93, "x" * 200_000)], items


@pytest.mark.parametrize("part", [seeds.BROADCAST_SEEDS, 25])
def test_equals_brute_force(spark, make_docs, cases, part):
    docs, items = cases
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = seeds.contaminated(
        make_docs(docs), benchmark, F.col("doc_id"), broadcast_seeds=part).collect()
    got = {(r.key, r.item_id): (r.n_windows, r.best) for r in rows}
    want = brute(docs, items)
    assert got == want and len(rows) == len(got)
    assert any(b == 11 for _, b in want.values()) and any(d == 92 for d, _ in want)


def test_rows_that_overlap_go(spark, make_docs, cases):
    docs, items = cases
    docs = docs + [(None, items[3][1]), (None, "clean"), (0, docs[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    left = seeds.decontaminate(make_docs(docs).withColumn("best", F.lit(1)), benchmark)
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars", "best"]
    bad = {d for d, _ in brute(docs, items) if d is not None}
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in left.collect() if r.text) == sorted(
        (d is None, d or 0, t) for d, t in docs if t and (d not in bad if d is not None else t == "clean"))


def test_nothing_to_compare(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    docs = make_docs(["a b c d e f", None])
    assert seeds.contaminated(docs, none, F.col("doc_id")).count() == 0
    assert seeds.decontaminate(docs, none).count() == 2
    assert seeds.decontaminate(docs, some).count() == 1
    assert seeds.contaminated(docs.where("false"), some, F.col("doc_id")).count() == 0

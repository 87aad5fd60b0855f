"""Components of the shingle join against all pairs."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelark.llm import overlap_join as join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute(docs):
    """[(doc_id, n, component)] by union-find over all pairs."""
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]):
            up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(docs)), key=str)


def answer(docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id)
                   for r in join.near_duplicates(docs).collect()), key=str)


def test_needed_overlap():
    for n, m in itertools.product(range(1, 60), repeat=2):
        t = int(join.needed(n, m))
        assert [100 * i >= 80 * (n + m - i) for i in (t - 1, t)] == [False, True]


@pytest.mark.parametrize("seed", range(4))
def test_divide_skip(seed):
    draw = np.random.default_rng(seed)
    base = np.sort(draw.choice(4000, 200, replace=False)).astype(np.uint64)
    candidates = [base, base[:1], base[:180]]
    for _ in range(40):
        keep = draw.random(200) > draw.random() * 0.3
        more = draw.choice(9000, draw.integers(0, 50), replace=False) + 5000
        candidates.append(np.unique(np.concatenate([base[keep], more.astype(np.uint64)])))
    want = [i for i, c in enumerate(candidates)
            if 100 * len(np.intersect1d(base, c)) >= 80 * len(np.union1d(base, c))]
    assert join.divide_skip(base, candidates) == want and len(want) > 2


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    word = lambda: f"w{draw.randrange(400)}"
    line = " ".join(word() for _ in range(12))
    out = []
    for _ in range(12):
        base = [word() for _ in range(draw.randrange(20, 90))]
        for _ in range(draw.randrange(1, 9)):
            copy = list(base)
            for _ in range(draw.randrange(4)):
                copy[draw.randrange(len(copy))] = word()
            out.append(" ".join(copy).upper() if draw.random() < .3 else "\n".join(copy))
            base = copy if draw.random() < .4 else base
    out += [line + "\n" + " ".join(word() for _ in range(40)) for _ in range(20)]
    hub = [word() for _ in range(60)]
    for i in range(30):  # near copies of one text, each with an edit of its own
        copy = list(hub)
        copy[i * 2] = f"x{i}"
        out.append(" ".join(copy))
    out += ["a b", "A  b", "b a", "a b c d", "a b c d", "", None, " \n", "q", "q " * 5, "q " * 50,
            "same text of a few words here"] + ["copied text of many words that repeats"] * 9
    draw.shuffle(out)
    return out


def test_components_equal_all_pairs(make_docs, texts):
    docs = list(enumerate(texts))
    assert answer(make_docs(docs, partitions=4)) == brute(docs)


def test_frequent_shingles_change_nothing(make_docs, texts, monkeypatch):
    monkeypatch.setattr(join, "SAMPLED", 1)
    monkeypatch.setattr(join, "BLOCK", 3)
    monkeypatch.setattr(join, "HEADS", 1)
    monkeypatch.setattr(join, "LINEAR", 0)
    docs = list(enumerate(texts))
    assert answer(make_docs(docs)) == brute(docs)


def test_far_copies_of_one_original(make_docs, monkeypatch):
    """300 copies, most with too many edits to link: pairs stay linear in them."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(300):
        copy = list(words)
        for at in rng.sample(range(150), i % 10):
            copy[at] = f"v{rng.randrange(10 ** 6)}"
        for j in range(rng.choice([0, 0, 0, 12])):
            copy.append(f"t{j}")
        texts.append(" ".join(copy))
    docs = list(enumerate(texts))
    compared, linked = [], join.linked

    def counted(pairs, *others):
        compared.append(pairs.count())
        return linked(pairs, *others)

    monkeypatch.setattr(join, "linked", counted)
    assert answer(make_docs(docs)) == brute(docs)
    assert sum(compared) <= 12 * len(docs)


def test_null_and_repeated_ids(make_docs):
    text = "one two three four five six seven eight nine ten"
    docs = [(5, text), (5, text), (5, "other words entirely in this one"), (None, text),
            (None, "all alone here"), (7, "other words entirely in this one"), (None, None), (2, "z")]
    rows = join.near_duplicates(make_docs(docs).withColumn("node", F.lit("clash"))).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == sorted(
        [(5, 6, 5), (5, 6, 5), (5, 2, 5), (None, 6, 5), (None, 1, None), (7, 2, 5), (None, 0, None),
         (2, 1, 2)], key=str)
    left = join.one_of_each(make_docs(docs)).collect()
    assert sorted((r.text for r in left), key=str) == sorted(
        [text, "other words entirely in this one", "all alone here", None, "z"], key=str)


def test_join_of_nothing(make_docs):
    assert join.near_duplicates(make_docs(["a"]).where("false")).count() == 0
    assert join.one_of_each(make_docs(["a"]).where("false")).count() == 0


def test_chain_of_links(spark):
    links = spark.createDataFrame(
        [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in join.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 95: 90, 90: 90}


def test_components_joined_by_more_links(spark):
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    first = [(1, 2), (5, 6), (8, 9), (20, 21)]
    more = [(2, 6), (40, 9), (50, 51), (0, 51)]
    got = join.joined_components(join.components(frame(first)), frame(more))
    want = join.components(frame(first + more))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_nodes_with_the_same_long_lists_meet_only_in_short_ones(spark):
    """Sets of 40 need 5 shared rows: 60 nodes share 4, each two of them 3 more."""
    rows = [(h, node, 40) for node in range(60) for h in range(4)]
    rows += [(100 + 10 * (node // 2) + i, node, 40) for node in range(60) for i in range(3)]
    rows += [(1000 + 7 * k + i, node, 40) for k in range(20) for node in (k, k + 30) for i in range(2)]
    lists = spark.createDataFrame(rows, "h long, node long, n long").withColumn("root", F.col("node"))
    lists = join._with_roots(lists, lists.select("node", "root").limit(0))
    shared = {n: {r[0] for r in rows if r[1] == n} for n in range(60)}
    wanted = {(a, b) for a, b in itertools.combinations(range(60), 2) if len(shared[a] & shared[b]) >= 5}
    assert {tuple(r) for r in join._cross_pairs(lists).collect()} >= wanted
    assert len(wanted) > 30
    # All meetings of two nodes in a list are over 7 000.
    assert join._first_meetings(lists).count() <= 300


def test_no_pair_that_meets_often_enough_is_left_out(spark):
    rng = random.Random(5)
    size = {node: rng.choice([20, 22, 25, 40, 44]) for node in range(80)}
    rows = [(h, node, n) for node, n in size.items()
            for h in rng.sample(range(30), n - (4 * n + 4) // 5 + 1)]
    roots = spark.createDataFrame([(node, node % 9) for node in range(40)], "node long, root long")
    lists = spark.createDataFrame(rows, "h long, node long, n long").withColumn("root", F.col("node"))
    lists = join._with_roots(lists, roots)
    shared = {node: {r[0] for r in rows if r[1] == node} for node in size}
    root = {node: node % 9 if node < 40 else node for node in size}

    def least(n, m):
        t = (4 * (n + m) + 8) // 9
        return min(t - (4 * x + 4) // 5 + 1 for x in (n, m))

    wanted = {(a, b) for a, b in itertools.combinations(size, 2)
              if root[a] != root[b] and 5 * min(size[a], size[b]) >= 4 * max(size[a], size[b])
              and len(shared[a] & shared[b]) >= least(size[a], size[b])}
    assert len(wanted) > 50
    found = [tuple(r) for r in join._cross_pairs(lists).collect()]
    assert wanted <= set(found) and len(found) == len(set(found))

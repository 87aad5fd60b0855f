"""Sharding and mixing against their definitions."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from framelark.llm.external_shuffle import external_shuffle
from framelark.llm.source_mixing import mix

TEXTS = [f"t{i} " + "word " * (i % 7) for i in range(97)] + [None, "", "same", "same"]


@pytest.mark.parametrize("bucket_rows", [7, 40, 1000])
def test_shards_hold_each_row_once(make_docs, bucket_rows):
    docs = make_docs(TEXTS).withColumn("shard", F.lit("clash"))
    rows = external_shuffle(docs, 8, bucket_rows=bucket_rows).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(enumerate(TEXTS))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 1


def test_order_is_shuffled_and_repeatable(make_docs):
    def order(partitions):
        rows = external_shuffle(
            make_docs(TEXTS, partitions=partitions), 3, bucket_rows=20
        ).collect()
        return [r.doc_id for r in sorted(rows, key=lambda r: (r.slot, r.shard))]

    first = order(2)
    assert first == order(5) != sorted(first)


def test_one_exchange_moves_the_records(make_docs):
    plan = external_shuffle(make_docs(TEXTS), 8, bucket_rows=10)._jdf.queryExecution().toString()
    final = plan[plan.index("== Physical Plan =="):]
    assert final.count("REPARTITION_BY_NUM") >= 1
    assert "hashpartitioning(bucket#" not in final.split("Union")[0]


def test_shuffle_of_rows_that_repeat_or_lack_values(make_docs, spark):
    empty = external_shuffle(make_docs(TEXTS).where("false"), 4)
    assert empty.columns[-2:] == ["shard", "slot"] and empty.count() == 0
    twice = make_docs([(None, None)] * 9 + [(3, "a b")] * 8)
    rows = external_shuffle(twice, 4, bucket_rows=5).collect()
    assert len(rows) == 17 and Counter(r.shard for r in rows) == {0: 5, 1: 4, 2: 4, 3: 4}


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), float(sum(sizes.values()))
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


def check_mix(docs):
    rows = mix(docs).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    sizes = {s: sum(r.size for r in rs) for s, rs in by.items()}
    wanted = brute_targets(sizes)
    for s, rs in by.items():
        assert all(abs(r.target - wanted[s]) < 1e-6 * max(1, wanted[s]) for r in rs)
        assert all(r.source_size == sizes[s] and 0 <= r.taken <= 3 * r.size for r in rs)
        off = abs(sum(r.taken for r in rs) - wanted[s])
        largest = max(sum(r.size for r in rs if r.doc_id == d) for d in {r.doc_id for r in rs})
        assert off <= largest / 2 + 1e-6, (s, off)
    return rows


def test_mix_comes_near_its_targets(make_docs):
    rows = check_mix(make_docs(["w " * (i * 37 % 90) for i in range(300)]))
    assert sorted(r.doc_id for r in rows) == list(range(300))


def test_mix_with_capped_null_and_empty_sources(make_docs):
    docs = make_docs(["w " * (1 + i * 37 % 90) for i in range(200)] + [None, ""])
    source = F.when(F.col("doc_id") < 4, "a").when(F.col("doc_id") > 198, "zz").when(
        F.col("doc_id") % 2 == 0, "b")
    check_mix(docs.withColumn("source", source).withColumn("target", F.lit("clash")))


def test_mix_of_ties_and_nothing(make_docs):
    rows = check_mix(make_docs([(7, "a b c")] * 5 + [(None, "d e")] * 4 + [(8, None)]))
    assert len(rows) == 10
    assert mix(make_docs(["a"]).where("false")).count() == 0
    assert [r.taken for r in mix(make_docs([None, ""])).collect()] == [0, 0]


def test_mix_repeats_itself(make_docs):
    texts = ["w " * (i * 31 % 70) for i in range(150)]
    taken = [
        {r.doc_id: r.taken for r in mix(make_docs(texts, partitions=p)).collect()} for p in (2, 6)
    ]
    assert taken[0] == taken[1]

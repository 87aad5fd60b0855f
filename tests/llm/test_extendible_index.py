import hashlib
import re

import numpy as np
import pytest

from framelark.llm.extendible_index import (
    build_index, drop_duplicates, exact_duplicates, split_directory,
)


def brute(rows):
    """{(row number): (keep_id, size, sha)} and the groups' bodies."""
    groups = {}
    for i, (key, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append(i)
    out = []
    for body, members in groups.items():
        best = min(members, key=lambda i: (
            -len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0, i))
        sha = hashlib.sha256(body.encode()).hexdigest()
        out += [(rows[i][0], rows[best][0], len(members), sha) for i in members]
    return sorted(out, key=repr)


def found(df):
    rows = df.collect()
    kept = {}
    for r in rows:
        kept.setdefault(r["text_sha256"], []).append((r["kept"], r["doc_id"] == r["keep_id"]))
    for flags in kept.values():  # one row of each group stays, and it has the kept id
        assert sum(k for k, _ in flags) == 1
        assert all(same for k, same in flags if k)
    return sorted(
        [(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows], key=repr)


TEXTS = [
    "a b", "ab", "a\tb ", "ab ", "A b", None, "", " \n", "é x", "éx", "éx", "z" * 300_000,
    "z " * 300_000, "long tail", "ab", "longtail\x0b\x0c\r",
]


weak = lambda body: len(body) % 3  # noqa: E731 (by value, for the workers)
constant = lambda body: 2**64 - 1


@pytest.mark.parametrize("hashed", [None, weak, constant])
def test_equals_brute_force(make_docs, hashed):
    docs = make_docs(TEXTS)
    more = {} if hashed is None else {"hashed": hashed}
    assert found(exact_duplicates(docs, **more)) == brute(list(enumerate(TEXTS)))


@pytest.mark.parametrize("hashed", [None, constant])
def test_hot_texts_on_pages(make_docs, hashed):
    """A third of all rows equal: more entries of one hash than a bucket holds."""
    texts = ["hot passage " * 5 + " " * (i % 7) if i % 3 == 0 else f"text {i % 90}" for i in range(900)]
    docs = make_docs(texts, partitions=5)
    more = {} if hashed is None else {"hashed": hashed}
    index = build_index(docs, bucket_bytes=2_000, buffer_bytes=500, **more)
    assert index.directory.where("pages > 1").count() > 0
    heads = [r["body"] for r in index.buckets.where("body is not null").collect()]
    assert len(heads) == len({bytes(b) for b in heads}) == len(
        {re.sub(r"\s", "", t) for t in texts})
    got = exact_duplicates(docs, bucket_bytes=2_000, buffer_bytes=500, **more)
    assert found(got) == brute(list(enumerate(texts)))


def test_repeated_rows_and_null_keys(make_docs):
    rows = [(1, "same"), (1, "same"), (None, "same "), (None, "only null"), (None, "only null"), (7, "x")]
    assert found(exact_duplicates(make_docs(rows))) == brute(rows)


def test_empty_table_and_clashing_names(spark, make_docs):
    assert exact_duplicates(make_docs([])).count() == 0
    docs = make_docs(["a a", "aa", "b"]).selectExpr(
        "doc_id", "text", "1 as entry", "2 as h", "3 as body", "4 as `a.b`", "5 as kept", "6 as row",
        "7 as `k``q`", "8 as _key")
    rows = drop_duplicates(docs).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(0, "a a", 1, 2, 3, 4, 5, 6, 7, 8), (2, "b", 1, 2, 3, 4, 5, 6, 7, 8)]
    assert rows[0].__fields__ == docs.columns
    carried = exact_duplicates(docs, carry=["a.b", "kept", "entry"])
    assert carried.columns == [
        "doc_id", "keep_id", "group_size", "kept", "text_sha256", "a.b", "entry"]
    assert carried.count() == 3


def test_directory_splits_only_overfull_buckets():
    weights = np.array([9, 1, 0, 0, 1, 1, 1, 1])
    low = np.where(weights, np.arange(8) * 10, np.iinfo(np.int64).max)
    high = np.where(weights, np.arange(8) * 10 + 5, np.iinfo(np.int64).min)
    assert split_directory(weights, low, high, 8).tolist() == [3, 3, 2, 2, 1, 1, 1, 1]
    high[:2], low[:2] = 0, 0  # one hash: no split below the bucket that holds it alone
    assert split_directory(weights, low, high, 8).tolist() == [1] * 8

"""Line templates against a plain version of the tree."""

import random
import re
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from framelark.llm.line_templates import (
    NUMBER, VARIABLE, WIDE_GAP, document_lines, drop_templates, masked, shared_leaves,
)


def brute(docs, depth=2, min_docs=3, similarity=0.6):
    order = lambda d: (d is None, d or 0)
    lines = []
    for d, text in docs:
        for i, line in enumerate((text or "").split("\n")):
            t = tuple("<*>" if re.search("[0-9]", w) else w
                      for w in re.findall(r"[^\x20\x09-\x0D]+", line))
            if len(t) >= 3:
                lines.append((d, i, t, (len(t), t[:depth])))
    leaf_docs, owners, place = defaultdict(set), defaultdict(set), {}
    for d, i, t, leaf in lines:
        leaf_docs[leaf].add(d)
        owners[t].add(d)
        place[t] = min(place.get(t, ((True, 9**9), 0)), (order(d), i))
    counts = Counter()
    for t, own in owners.items():
        for at, w in enumerate(t):
            counts[len(t), t[:depth], at, w] += len(own)
    groups = defaultdict(list)
    for t in owners:
        leaf = (len(t), t[:depth])
        held = tuple((at, w) for at, w in enumerate(t)
                     if w != "<*>" and counts[(*leaf, at, w)] >= min_docs)
        if len(leaf_docs[leaf]) >= min_docs and held and len(held) >= similarity * len(t):
            groups[leaf, held].append(t)
    first = {}
    for ts in groups.values():
        if sum(len(owners[t]) for t in ts) >= min_docs:
            first |= dict.fromkeys(ts, min(place[t] for t in ts))
    gone = {(d, i) for d, i, t, _ in lines if t in first and (order(d), i) != first[t]}
    out = []
    for d, text in docs:
        parts = [] if text is None else text.split("\n")
        kept = [x for i, x in enumerate(parts) if (d, i) not in gone]
        out.append((d, len(parts), len(parts) - len(kept), None if text is None else "\n".join(kept)))
    return sorted(out, key=str)


def answer(docs):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept)
                   for r in drop_templates(docs).collect()), key=str)


def test_equals_plain_tree(make_docs):
    draw = random.Random(2)
    word = lambda: draw.choice(["alpha", "beta", "gamma", "delta", "eps"]) + draw.choice("abcdefgh")
    docs = []
    for d in range(60):
        lines = [" ".join(word() for _ in range(draw.randrange(0, 9))) for _ in range(4)]
        lines += [f"user {word()} logged in from 10.0.0.{d}", f"page {d} of 90"][:draw.randrange(3)]
        lines += ["all rights reserved by them", "all rights reserved by them"][:draw.randrange(3)]
        lines += ["", " ", "a b", f"the value of {word()} is now {word()} for sure"]
        draw.shuffle(lines)
        docs.append((d, "\n".join(lines)))
    docs += [(70, None), (71, ""), (72, "x " * 60_000), (73, docs[0][1])]
    want = brute(docs)
    assert answer(make_docs(docs).withColumn("kept", F.lit("clash"))) == want
    assert sum(r[2] for r in want) > 60
    assert any("logged in" in (r[3] or "") for r in want)  # the first one stays


def test_null_and_repeated_rows(make_docs):
    line = "this page was printed on paper"
    docs = [(1, line), (1, line), (2, line + "\nown words stay here"), (None, line), (3, "a\nb")]
    rows = answer(make_docs(docs))
    assert rows == sorted([(1, 1, 0, line), (1, 1, 0, line), (2, 2, 1, "own words stay here"),
                           (None, 1, 1, ""), (3, 2, 0, "a\nb")], key=str)
    assert answer(make_docs(docs).where("false")) == []


def test_gaps_and_numbers(make_docs):
    """Words part at every kind of white space; a digit anywhere hides the whole word."""
    lines = ["  page \t of\x0b\x0cbook x{}y  ", "page of book {}\r", "9{0} 8{0}a b{0} \u00e9t\u00e9 \u00a0 z"]
    docs = [(d, "\n".join(x.format(d) for x in lines) + f"\n \t\nown {'abcde'[d]}{'vwxyz'[d]} text")
            for d in range(5)]
    want = brute(docs)
    assert answer(make_docs(docs)) == want
    assert sum(r[2] for r in want) == 9


def test_lines_travel_as_strings(make_docs):
    """A line is a string, not an array of its words, and its text is parsed once."""
    lines = document_lines(make_docs([(1, "a b c 4\nd e f")]), "doc_id", "text", 2)
    assert not [n for n, t in lines.dtypes if t.startswith("array")]
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(regexp_replace(") == 1


def test_only_lines_of_shared_leaves_go_on(make_docs):
    lines = document_lines(make_docs([
        (1, "a b c\na b d\nx y z"), (2, "a b c\nx y z"), (3, "a b e\nlong a b c"), (None, "x y z 4")
    ]), "doc_id", "text", 2)
    got = sorted((r.doc, r.t) for r in shared_leaves(lines).collect())
    assert got == [(1, "a b c"), (1, "a b d"), (2, "a b c"), (3, "a b e")]


def test_lines_without_digits_are_not_searched_for_words(spark):
    """Masking such text takes a fraction of the two searches over all of it."""
    text = spark.range(0, 40_000, 1, 4).select(F.concat(
        F.repeat(F.lit("an ordinary sentence of several plain words "), 10), "id").alias("t")
    ).select(F.translate("t", "0123456789", "abcdefghij").alias("t")).cache()
    text.count()
    searched = F.regexp_replace(F.regexp_replace("t", NUMBER, VARIABLE), WIDE_GAP, " ")

    def seconds(column):
        took = []
        for _ in range(3):
            at = time.perf_counter()
            text.select(F.sum(F.length(column))).collect()
            took.append(time.perf_counter() - at)
        return min(took)

    assert seconds(masked(F.col("t"))) < 0.6 * seconds(searched)
    text.unpersist()

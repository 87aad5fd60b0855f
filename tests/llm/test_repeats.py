"""Removal of repeated windows against a plain index of all windows."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from framelark.llm import anchors, fm_index, repeat_intervals


def brute_words(docs, window=13):
    """[(doc_id, n, removed, kept)] for rows (doc_id, text)."""
    least, rows = {}, []
    order = lambda d: (d is None, d or 0)
    for d, text in docs:
        words = (text or "").encode().split()
        rows.append((d, words))
        for i in range(len(words) - window + 1):
            w = tuple(words[i:i + window])
            least[w] = min(least.get(w, order(d)), order(d))
    out = []
    for d, words in rows:
        gone = set()
        for i in range(len(words) - window + 1):
            if least[tuple(words[i:i + window])] < order(d):
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        out.append((d, len(words), len(gone), kept))
    return sorted(out, key=str)


def brute_bytes(docs, window=100):
    first, out = {}, []
    order = lambda d: (d is None, d or 0)
    raws = [(d, (t or "").encode()) for d, t in docs]
    for d, raw in raws:
        for i in range(len(raw) - window + 1):
            w = raw[i:i + window]
            first[w] = min(first.get(w, (order(d), i)), (order(d), i))
    for d, raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - window + 1):
            if first[raw[i:i + window]] < (order(d), i):
                gone[i:i + window] = True
        gone = gone[:-1]
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((d, len(raw), int(gone.sum()), spans, raw[:0] + bytes(
            b for b, g in zip(raw, gone) if not g)))
    return sorted(out, key=str)


def words_of(docs, **options):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept)
                   for r in fm_index.drop_repeats(docs, **options).collect()), key=str)


def bytes_of(docs, **options):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept))
                   for r in repeat_intervals.drop_repeats(docs, **options).collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(11)
    word = lambda: draw.choice("abcdefgh") * draw.randrange(1, 4) + str(draw.randrange(30))
    shared = [[word() for _ in range(n)] for n in (13, 14, 40, 90, 12)]
    out = []
    for _ in range(60):
        text = [word() for _ in range(draw.randrange(0, 60))]
        for _ in range(draw.randrange(3)):
            part = list(draw.choice(shared))
            if draw.random() < .5:
                part[draw.randrange(len(part))] = word()
            at = draw.randrange(len(text) + 1)
            text[at:at] = part
        out.append(draw.choice([" ", "\n", "  "]).join(text))
    out += [out[3], out[3], out[7] + " tail", "ä é " * 90, "ä é " * 70, "x" * 400, "x" * 99, "x" * 350,
            "", None, " \t", "q " * 30, "q " * 12, "z y " * 200, "\x0b".join(shared[2])]
    line = " ".join(word() for _ in range(12))
    out += [f"{word()} {line} {word()} {word()}" for _ in range(25)]
    draw.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("shard_bytes", [fm_index.SHARD_BYTES, 500])
def test_words(make_docs, corpus, shard_bytes):
    assert words_of(make_docs(corpus), shard_bytes=shard_bytes) == brute_words(corpus)


@pytest.mark.parametrize("shard_bytes", [repeat_intervals.SHARD_BYTES, 2500])
def test_bytes(make_docs, corpus, shard_bytes):
    assert bytes_of(make_docs(corpus), shard_bytes=shard_bytes) == brute_bytes(corpus)


def test_given_documents(make_docs):
    docs = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    assert words_of(make_docs(docs)) == brute_words(docs)
    assert bytes_of(make_docs(docs)) == brute_bytes(docs)


def test_null_and_repeated_ids(make_docs):
    text = " ".join(f"word{i}" for i in range(40))
    docs = [(4, text), (4, text), (None, "start " + text), (2, "other"), (9, text[50:]), (None, None)]
    frame = make_docs(docs).withColumn("key", F.lit("clash")).withColumn("doc", F.lit("clash"))
    assert words_of(frame) == brute_words(docs)
    assert bytes_of(frame) == brute_bytes(docs)
    assert words_of(frame.where("false")) == bytes_of(frame.where("false")) == []


@pytest.mark.parametrize("seed", range(5))
def test_prefix_tree(seed):
    """All maximal repeats of random contents, with all their places."""
    draw = random.Random(seed)
    contents = [bytes(draw.choice(b"ab") for _ in range(draw.randrange(6, 30))) for _ in range(8)]
    number, content, offset, length = repeat_intervals.repeat_groups(contents, 5)
    got = {}
    for g, c, o, n in zip(number.tolist(), content.tolist(), offset.tolist(), length.tolist()):
        string = contents[c][o:o + n]
        got.setdefault(g, [string, set()])[1].add((c, o))
        assert got[g][0] == string
    want = {}
    for c, raw in enumerate(contents):
        for o in range(len(raw)):
            for e in range(o + 5, len(raw) + 1):
                want.setdefault(raw[o:e], set()).add((c, o))
    maximal = {}
    for string, places in want.items():
        before = {contents[c][o - 1] if o else -c - 1 for c, o in places}
        after = {contents[c][o + len(string)] if o + len(string) < len(contents[c]) else -c - 1
                 for c, o in places}
        if len(places) > 1 and len(before) > 1 and len(after) > 1:
            maximal[string] = places
    found = {s: p for s, p in got.values()}
    assert len(found) == len(got)
    assert {s: p for s, p in found.items() if s in maximal} == maximal
    assert all(want[s] == p for s, p in found.items())


@pytest.mark.parametrize("seed", range(3))
def test_wavelet_matrix_and_search(seed):
    draw = np.random.default_rng(seed)
    values = draw.integers(0, 37, 500)
    matrix = fm_index.WaveletMatrix(values, 37)
    symbol, at = draw.integers(0, 37, 200), draw.integers(0, 501, 200)
    assert matrix.count(symbol, at).tolist() == [
        int((values[:a] == s).sum()) for s, a in zip(symbol, at)]
    text = np.append(draw.integers(1, 4, 300), 0)
    index = fm_index.FMIndex(text, 4, 5)
    places, rows = index.windows(text, np.array([0, 100]), np.array([100, 300]), 5)
    assert sorted(places.tolist()) == [*range(96), *range(100, 296)]
    for p, r in zip(places, rows):
        assert (text[index.suffixes[r]:][:5] == text[p:p + 5]).all()
        if r:
            assert text[index.suffixes[r - 1]:][:5].tolist() < text[p:p + 5].tolist()


def test_pieces_hold_every_window_once():
    data = np.frombuffer(b"abc" * 90 + bytes(range(97, 123)) * 20, np.uint8)
    bounds = np.array([0, 0, 130, 270, 270, 300, len(data)])
    for unit in (anchors.Bytes(100), anchors.Words(2, 1)):
        doc, begin, stop, _, grams, _ = anchors.pieces(unit, data, bounds, True)
        got = [(d, i) for d, a, b in zip(doc, begin, stop) for i in range(a, b)]
        _, first, _ = unit.units(data, bounds)
        assert got == [(d, i) for d in range(6) for i in range(first[d], first[d + 1] - unit.window + 1)]


@pytest.mark.parametrize("module, name, of, brute", [
    (fm_index, "earlier_windows", words_of, brute_words),
    (repeat_intervals, "earlier_repeats", bytes_of, brute_bytes),
])
@pytest.mark.parametrize("common", [20_000, 50])
def test_no_shard_holds_all_borders_of_a_passage(make_docs, monkeypatch, module, name, of, brute, common):
    """One passage in every document, between words of each document's own."""
    passage = " ".join(f"word{i}" for i in range(40))
    docs = [(d, f"a{d} b{d} c{d} d{d} {passage} e{d} f{d} g{d} h{d}") for d in range(400)]
    search, most = getattr(module, name), 20_000

    def bounded(contents, firsts, unit):
        assert sum(map(len, contents)) <= most
        return search(contents, firsts, unit)

    monkeypatch.setattr(module, name, bounded)
    monkeypatch.setattr(anchors, "COMMON", common)
    assert of(make_docs(docs), shard_bytes=most // 8) == brute(docs)


def test_only_contents_with_a_repeat_are_indexed(monkeypatch):
    """Within a content or across two; a window at either end; too short ones."""
    rng = np.random.default_rng(5)
    own = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes()
    twice, border, within = own(100), own(130), own(101)
    contents = [own(200), twice + own(60), own(99), own(40) + twice, b"", own(150), border,
                border[:100], within + own(3) + within, twice[:99], own(100)]
    firsts = np.stack([np.arange(11)[::-1], np.arange(11) * 1000], axis=1)
    unit = anchors.Bytes(100)
    assert repeat_intervals.with_repeats(contents, unit).tolist() == [1, 3, 6, 7, 8]
    seen, groups = [], repeat_intervals.repeat_groups
    monkeypatch.setattr(repeat_intervals, "repeat_groups", lambda c, w: seen.extend(c) or groups(c, w))
    got = sorted(zip(*(x.tolist() for x in repeat_intervals.earlier_repeats(contents, firsts, unit))))
    assert got == [(1, 0, 100), (6, 0, 100), (8, 104, 101)]
    assert seen == [contents[i] for i in (1, 3, 6, 7, 8)]
    none = repeat_intervals.earlier_repeats([own(99), own(300), b""], firsts, unit)
    assert [len(x) for x in none] == [0, 0, 0]
    assert repeat_intervals.with_repeats([b"ab", b"ab"], unit).tolist() == []

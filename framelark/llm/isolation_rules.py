"""Quality rules with an isolation forest over rule statistics.

Every document gets counts of what the usual rules look at. A forest of trees
that split at random finds the documents that a few splits set apart: the mean
path length, against that of a random search tree, is the anomaly score. What
the trees split is the excess of each statistic over the range usual among good
rows, so that the spread of good documents does not hide the others. Usual
ranges come from all good rows; each tree grows on rows drawn from all labelled
ones, and the score above which a document is rejected is calibrated on all of
them, so that at most a stated share of the good ones falls. All documents are
counted and scored.
"""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelark.llm.common import quoted, staged, without
from framelark.llm.source_mixing import HASH_BITS, place
from framelark.llm.text import (
    SPACES, per_document, repeated_lines, repeated_words, slices, word_hashes, word_spans,
)
from framelark.operators.frames import running_total

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_capitals", "n_marks", "n_lines",
)
STATISTICS = 6
TREES, SUBSAMPLE, DEPTH = 100, 256, 8


def _bytes(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars, np.uint8))


SYMBOLS, MARKS = _bytes(b"#*$%&|<>"), _bytes(b"!?")
CAPITALS, BREAKS = _bytes(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes(b"\n")
CONTINUED = (np.arange(256) & 0xC0) == 0x80


def rule_counts(texts: pa.Array) -> np.ndarray:
    """One row per text: the counts named in ``COUNTS``."""
    out = [np.zeros((0, len(COUNTS)), np.int64)]
    for _, _, data, bounds in slices(texts):
        starts, ends, first = word_spans(data, bounds)
        raw = data.tobytes()
        out.append(np.stack([
            np.diff(first),
            per_document(~SPACES[data] & ~CONTINUED[data], bounds),
            per_document(SYMBOLS[data], bounds),
            [repeated_lines(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:])],
            repeated_words(word_hashes(data, starts, ends), first),
            per_document(CAPITALS[data], bounds),
            per_document(MARKS[data], bounds),
            per_document(BREAKS[data], bounds) + 1,
        ], axis=1).astype(np.int64))
    return np.concatenate(out)


def shares(counts: np.ndarray) -> np.ndarray:
    """The statistics that rules bound: characters a word and shares of words, lines, characters."""
    x = counts.astype(float)
    words, chars = np.maximum(x[:, 0], 1), np.maximum(x[:, 1], 1)
    return np.stack([
        x[:, 1] / words, x[:, 2] / words, x[:, 3] / x[:, 7], x[:, 4] / words,
        x[:, 5] / chars, x[:, 6] / words,
    ], axis=1)


def usual(x: np.ndarray, tolerated: float) -> np.ndarray:
    """The range of each statistic that all but a ``tolerated`` share at each end keep to."""
    return np.quantile(x, [tolerated, 1 - tolerated], axis=0)


def excess(x: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """What the trees split: how far a statistic lies below or above its usual range."""
    return np.concatenate([np.maximum(limits[0] - x, 0), np.maximum(x - limits[1], 0)], axis=1)


def search_length(n):
    """Mean path of a failed search in a random binary tree of n values."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(
    x: np.ndarray, seed: int, trees: int = TREES, subsample: int = SUBSAMPLE, depth: int = DEPTH,
    drawn: np.ndarray | None = None,
):
    """``(feature, cut, path)`` of complete binary trees, one row per tree.

    A tree grows on ``subsample`` rows of ``x``: those of its row of ``drawn``,
    or drawn here. A node that splits no further sends all to its left, with
    the path kept.
    """
    draw = np.random.Generator(np.random.PCG64(seed))
    size = 2 ** (depth + 1) - 1
    feature = np.zeros((trees, size), np.int64)
    cut = np.full((trees, size), np.inf)
    path = np.zeros((trees, size))
    for t in range(trees):
        rows = drawn[t] if drawn is not None else draw.choice(
            len(x), min(subsample, len(x)), replace=False)
        todo = [(0, 0, rows)]
        while todo:
            node, level, rows = todo.pop()
            path[t, node] = level + search_length(len(rows))
            if level == depth:
                continue
            low, high = x[rows].min(0), x[rows].max(0)
            free = np.flatnonzero(high > low)
            if len(free) == 0:  # nothing to split: hand the path down
                inner = node
                for _ in range(level, depth):
                    inner = 2 * inner + 1
                    path[t, inner] = path[t, node]
                continue
            f = draw.choice(free)
            at = draw.uniform(low[f], high[f])
            right = x[rows, f] >= at
            if right.all():  # the cut fell on the lowest value
                at, right = high[f], x[rows, f] >= high[f]
            feature[t, node], cut[t, node] = f, at
            todo += [(2 * node + 1, level + 1, rows[~right]), (2 * node + 2, level + 1, rows[right])]
    return feature, cut, path


def anomaly(x: np.ndarray, forest, subsample: int = SUBSAMPLE) -> np.ndarray:
    """Scores in (0, 1): 0.5 is average, near 1 is set apart at once."""
    feature, cut, path = forest
    depth = int(np.log2(feature.shape[1] + 1)) - 1
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for t in range(len(feature)):
        node = np.zeros(len(x), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, feature[t, node]] >= cut[t, node])
        total += path[t, node]
    return 2.0 ** (-total / len(feature) / float(search_length(subsample)))


def calibrate(scores: np.ndarray, good: np.ndarray, lost: float) -> float:
    """The score above which rows fall: best at telling apart (share of bad less
    share of good), of those that reject at most ``lost`` of the good."""
    if good.all() or not good.any():
        return np.inf
    cuts = np.unique(scores)
    good_lost = 1 - np.searchsorted(np.sort(scores[good]), cuts, "right") / good.sum()
    bad_caught = 1 - np.searchsorted(np.sort(scores[~good]), cuts, "right") / (~good).sum()
    allowed = good_lost <= lost
    return float(cuts[np.argmax(np.where(allowed, bad_caught - good_lost, -np.inf))])


def _at(n: int, share: float) -> tuple[int, int, float]:
    """The positions a quantile of ``n`` values lies between, and how far from the first."""
    at = (n - 1) * share
    return int(at), min(int(at) + 1, n - 1), at - int(at)


def usual_of(good: DataFrame, n: int, tolerated: float) -> np.ndarray:
    """``usual`` of all of the ``n`` rows ``(values, n)``, each standing for ``n`` equal ones."""
    wanted = [_at(n, share) for share in (tolerated, 1 - tolerated)]
    places = sorted({at for low, high, _ in wanted for at in (low, high)})
    cells = good.select(F.posexplode("values").alias("statistic", "value"), "n").groupBy(
        "statistic", "value").agg(F.sum("n").alias("n"))
    ranked = running_total(cells, ["statistic"], ["value"], None, F.col("n"), "upto")
    held = F.lit(False)
    for at in places:
        held = held | ((F.col("upto") > at) & (F.col("upto") - F.col("n") <= at))
    found = sorted((r["statistic"], r["upto"], r["value"]) for r in ranked.where(held).collect())

    def value(statistic: int, at: int) -> float:
        return next(v for s, upto, v in found if s == statistic and upto > at)

    return np.array([[
        np.quantile([value(s, low), value(s, high)], part) for s in range(STATISTICS)
    ] for low, high, part in wanted])


def calibrated(scored: DataFrame, n_good: int, n_bad: int, lost: float) -> float:
    """``calibrate`` over all rows ``(score, good, bad)`` of counted labels."""
    cells = scored.groupBy("score").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    for kind in ("good", "bad"):
        bucket = F.floor(F.col("score") * 4096)
        cells = running_total(cells, [], ["score"], bucket, F.col(kind), f"{kind}_upto")
    good_lost = 1 - F.col("good_upto") / n_good
    bad_caught = 1 - F.col("bad_upto") / n_bad
    return cells.where(good_lost <= lost).orderBy(
        (bad_caught - good_lost).desc(), "score").first()["score"]


def forest_rows(labelled: DataFrame, n: int, seed: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Statistics of the rows that the trees grow on, and which of them each tree takes.

    Each tree draws from all ``n`` rows. As many as all trees together take are
    gathered whole, for the trees to draw from.
    """
    drawn, places = None, np.arange(n)
    if n > TREES * SUBSAMPLE:
        draw = np.random.Generator(np.random.PCG64(seed))
        drawn = np.stack([draw.choice(n, SUBSAMPLE, replace=False) for _ in range(TREES)])
        places = np.unique(drawn)
        drawn = places.searchsorted(drawn)
    order = ["place", *COUNTS]
    ranked = running_total(
        labelled, [], order, F.shiftright("place", HASH_BITS - 12), F.col("n"), "upto")

    def taken(batches):
        for batch in batches:
            upto = batch.column("upto").to_numpy()
            first = places.searchsorted(upto - batch.column("n").to_numpy())
            yield batch.filter(pa.array(places.searchsorted(upto) > first))

    ranked = ranked.select("values", "n", "upto")
    rows = ranked.mapInArrow(taken, ranked.schema).toPandas().sort_values("upto")
    at = rows["upto"].to_numpy().searchsorted(places, "right")
    return np.stack(rows["values"].to_numpy())[at], drawn


def quality_rules(
    docs: DataFrame, labels: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text",
    doc_id: str = "doc_id", tolerated: float = 0.001, lost: float = 0.002, seed: int = 5,
) -> DataFrame:
    """``keep`` columns, the counts, ``base_failed``, ``anomaly`` and ``kept``.

    ``base_failed``: fewer than 10 words, or over a fifth of the words in 5-word
    windows that the text holds twice. The forest sees all rows of ``labels``
    (``doc_id``, ``quality``) that pass the base rules; without two kinds of
    labels nothing falls but by the base rules. Null text is empty; repeated rows get equal verdicts; ``keep``
    columns named like an output column are left out.
    """
    kept = without(docs.select(*keep), *COUNTS, "base_failed", "anomaly", "kept")
    kinds = [(f.name, f.dataType.simpleString()) for f in kept.schema]
    n_keep = len(kinds)
    schema = ", ".join(
        [f"`{n}` {k}" for n, k in kinds] + ["_id string"] + [f"{c} long" for c in COUNTS]
    )

    def count(batches):
        for batch in batches:
            found = rule_counts(batch.column(n_keep + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(n_keep + 1)]
                + [pa.array(found[:, i]) for i in range(len(COUNTS))],
                names=[n for n, _ in kinds] + ["_id", *COUNTS])

    counted = staged(docs.select(
        *quoted(kept), F.col(doc_id).cast("string").alias("_id"), F.col(text).alias("_text")
    ).mapInArrow(count, schema))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    known = labels.where("quality is not null").groupBy(
        F.col(doc_id).cast("string").alias("_id")).agg(F.min("quality").alias("quality"))
    sample = counted.where(~failed).select("_id", *COUNTS).join(known, "_id").groupBy(
        place(F.col("_id"), seed).alias("place"), *COUNTS, "quality").agg(F.count(F.lit(1)).alias("n"))

    def state(batches):
        for batch in batches:
            values = shares(np.stack([batch.column(n).to_numpy() for n in COUNTS], axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.FixedSizeListArray.from_arrays(
                    pa.array(values.ravel()), STATISTICS).cast(pa.list_(pa.float64()))],
                names=[*batch.schema.names, "values"])

    weighed = sample.select("place", *COUNTS, "n", (F.col("quality") > 0).alias("good"))
    labelled = staged(weighed.mapInArrow(state, "place long, " + ", ".join(
        f"{c} long" for c in COUNTS) + ", n long, good boolean, values array<double>"))
    n_good, n_bad = labelled.agg(*[
        F.coalesce(F.sum(F.when(kind, F.col("n"))), F.lit(0))
        for kind in (F.col("good"), ~F.col("good"))]).first()
    forest, limits, limit = None, None, np.inf
    if n_good and n_bad:
        limits = usual_of(labelled.where("good").select("values", "n"), n_good, tolerated)
        x, drawn = forest_rows(labelled, n_good + n_bad, seed)
        forest = grow(excess(x, limits), seed, drawn=drawn)

        def score(batches):
            for batch in batches:
                values = batch.column("values").flatten().to_numpy().reshape(-1, STATISTICS)
                n, good = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "good"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anomaly(excess(values, limits), forest)), pa.array(n * good),
                     pa.array(n * ~good)], names=["score", "good", "bad"])

        limit = calibrated(labelled.mapInArrow(
            score, "score double, good long, bad long"), n_good, n_bad, lost)

    def judge(batches):
        for batch in batches:
            counts = np.stack([batch.column(n).to_numpy() for n in COUNTS], axis=1)
            score = np.zeros(len(counts)) if forest is None else anomaly(
                excess(shares(counts), limits), forest)
            bad = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n, _ in kinds] + [pa.array(counts[:, i]) for i in range(len(COUNTS))]
                + [pa.array(bad), pa.array(score), pa.array(~bad & (score <= limit))],
                names=[n for n, _ in kinds] + [*COUNTS, "base_failed", "anomaly", "kept"])

    return counted.mapInArrow(judge, ", ".join(
        [f"`{n}` {k}" for n, k in kinds] + [f"{c} long" for c in COUNTS]
        + ["base_failed boolean, anomaly double, kept boolean"]))

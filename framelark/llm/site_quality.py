"""Quality classifier with hierarchical empirical Bayes over sites.

Evidence of a document is the log odds that two logistic models, for low quality
and for toxic text, give to its words, word beginnings and binned character
statistics; they are fitted here on a bounded sample of labelled rows. Evidence
of a site comes from all documents: grouped sums of the document probabilities
give each host, and each path below it, a posterior rate. A sparse path shrinks
to its host and a sparse host to the global rate; how strongly, the spread
between the groups says (method of moments). A document's posterior log odds are
its own evidence moved by how its path's rate differs from the global one.
"""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelark.llm.common import quoted, staged, without
from framelark.llm.isolation_rules import CAPITALS, CONTINUED, MARKS, SYMBOLS
from framelark.llm.source_mixing import place
from framelark.llm.text import SPACES, per_document, slices, word_hashes, word_spans

TARGETS = ("low", "toxic")
PREFIXES = (0, 4, 5)  # whole words and word beginnings of so many bytes
BITS = 20
BINS = 24
ADDED = ("low_evidence", "toxic_evidence", "low_rate", "toxic_rate", "p_low", "p_toxic", "kept")


def _bins(share: np.ndarray) -> np.ndarray:
    return np.minimum((share * 20).astype(np.int64), BINS - 1)


def document_features(texts: pa.Array, wanted: np.ndarray | None = None):
    """Distinct features of each text: ``(feature numbers, bounds per text)``.

    ``wanted`` flags the feature numbers to look for (default: all).
    """
    out, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, _, data, bounds in slices(texts):
        starts, ends, first = word_spans(data, bounds)
        n_docs, words = len(bounds) - 1, np.maximum(np.diff(first), 1)
        doc = np.repeat(np.arange(n_docs), np.diff(first))
        found = []
        for p, prefix in enumerate(PREFIXES):
            value = word_hashes(data, starts, ends, prefix)
            if p == 0:
                again = np.zeros(len(value), bool)
                again[1:] = (value[1:] == value[:-1]) & (doc[1:] == doc[:-1])
            number = (value >> np.uint64(64 - BITS)).astype(np.int64) << 2 | p
            hit = slice(None) if wanted is None else wanted[number]
            found.append(doc[hit] << 32 | number[hit])
        chars = per_document(~SPACES[data] & ~CONTINUED[data], bounds)
        stats = (
            per_document(CAPITALS[data], bounds) / np.maximum(chars, 1),
            per_document(SYMBOLS[data], bounds) / words, per_document(MARKS[data], bounds) / words,
            chars / words / 12, per_document(again, first) / words, np.log1p(words) / 12,
        )
        for s, share in enumerate(stats):
            found.append(np.arange(n_docs) << 32 | (s * BINS + _bins(share)) << 2 | len(PREFIXES))
        keys = np.unique(np.concatenate(found))
        out.append(keys & (2**32 - 1))
        counts.append(np.bincount(keys >> 32, minlength=n_docs))
    return np.concatenate(out), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


def _entropy(*parts):
    return sum(np.where(p > 0, p * np.log(np.maximum(p, 1e-12)), 0.0) for p in parts)


def informative(features: np.ndarray, doc: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` features that tell most about ``y`` (log-likelihood ratio)."""
    seen = np.bincount(features, minlength=4 << BITS)
    both = np.bincount(features[y[doc] > 0], minlength=4 << BITS)
    values = np.flatnonzero(seen >= 3)
    seen, both = seen[values].astype(float), both[values].astype(float)
    n, ones = len(y), y.sum()
    gain = _entropy(both, seen - both, ones - both, n - ones - seen + both) - _entropy(
        seen, n - seen)
    return np.sort(values[np.argsort(-gain, kind="stable")[:most]])


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, steps: int = 300):
    """Weights and intercept: accelerated gradient steps on the mean loss."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(12):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    ridge = np.full(x.shape[1], penalty / len(x), np.float32)
    ridge[-1] = 0
    rate = 1 / (0.25 * float(np.linalg.norm(x @ v) ** 2) / len(x) + penalty / len(x))
    w = ahead = np.zeros(x.shape[1], np.float32)
    for i in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - np.float32(rate) * (x.T @ (p - y) / len(x) + ridge * ahead)
        ahead, w = new + np.float32(i / (i + 3)) * (new - w), new
    return w[:-1].astype(float), float(w[-1])


def fit(features: np.ndarray, bounds: np.ndarray, y: np.ndarray, most: int):
    """``(feature numbers, weights, intercept)`` of one target."""
    ones = y.sum()
    if ones in (0, len(y)):  # one kind of label says nothing about features
        odds = np.log((ones + 0.5) / (len(y) - ones + 0.5))
        return np.zeros(0, np.int64), np.zeros(0), float(odds)
    doc = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(bounds))
    chosen = informative(features, doc, y, most)
    column = np.full(4 << BITS, -1, np.int32)
    column[chosen] = np.arange(len(chosen))
    column = column[features]
    x = np.zeros((len(y), len(chosen)), np.float32)
    x[doc[column >= 0], column[column >= 0]] = 1
    return (chosen, *fit_logistic(x, y.astype(np.float32)))


def evidence(features: np.ndarray, bounds: np.ndarray, model) -> np.ndarray:
    chosen, weights, intercept = model
    if len(chosen) == 0:
        return np.full(len(bounds) - 1, intercept)
    at = np.minimum(np.searchsorted(chosen, features), len(chosen) - 1)
    value = np.where(chosen[at] == features, weights[at], 0.0)
    return np.diff(np.concatenate(([0.0], np.cumsum(value)))[bounds]) + intercept


def train(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, max_labelled: int,
          most: int, seed: int):
    """One model per target from the labelled rows with the smallest id hashes."""
    known = labels.where(F.col(doc_id).isNotNull()).groupBy(
        F.col(doc_id).cast("string").alias("_id")
    ).agg(F.min("quality").alias("_quality"), F.max("toxic").alias("_toxic")).orderBy(
        place(F.col("_id"), seed)
    ).limit(max_labelled)  # which bounds what is broadcast and gathered here
    rows = docs.select(F.col(doc_id).cast("string").alias("_id"), F.col(text).alias("_text")).join(
        F.broadcast(known), "_id").select("_text", "_quality", "_toxic", "_id")

    def gather(batches):
        for batch in batches:
            found, bounds = document_features(batch.column(0))
            found = found.astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(3), batch.column(1), batch.column(2),
                pa.array([found[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
            ], names=["id", "quality", "toxic", "features"])

    sample = rows.mapInArrow(
        gather, "id string, quality int, toxic int, features binary").toPandas()
    sample = sample.drop_duplicates("id").sort_values("id")  # the fit sees one order
    models = []
    for name, one in (("quality", 0), ("toxic", 1)):
        part = sample[sample[name].notna()]
        found = np.frombuffer(b"".join(part["features"]), np.int32)
        bounds = np.concatenate(([0], np.cumsum([len(f) // 4 for f in part["features"]])))
        y = (part[name].to_numpy() == one).astype(float)
        if len(y) == 0:
            models.append((np.zeros(0, np.int64), np.zeros(0), -20.0))
        else:
            models.append(fit(found, bounds.astype(np.int64), y, most))
    return models


def with_evidence(docs: DataFrame, text: Column, keep: DataFrame, models) -> DataFrame:
    """``keep`` columns and the log odds of both targets."""
    kinds = [(f.name, f.dataType.simpleString()) for f in keep.schema]

    def score(batches):
        wanted = np.zeros(4 << BITS, bool)
        for chosen, _, _ in models:
            wanted[chosen] = True
        for batch in batches:
            found, bounds = document_features(batch.column(len(kinds)), wanted)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(kinds))]
                + [pa.array(evidence(found, bounds, m)) for m in models],
                names=[n for n, _ in kinds] + list(ADDED[:2]))

    return docs.select(*quoted(keep), text.alias("_text")).mapInArrow(score, ", ".join(
        [f"`{n}` {k}" for n, k in kinds] + ["low_evidence double, toxic_evidence double"]))


def _strength(groups: DataFrame, rate: str, n: str, squares: str, overall: float) -> float:
    """Pseudo-count of the prior: Beta moments from the spread between groups."""
    between = F.pow(F.col(rate) - overall, 2) * F.col(n)
    within = F.greatest(F.col(squares) / F.col(n) - F.pow(rate, 2), F.lit(0.0))
    row = groups.agg(F.sum(between).alias("b"), F.sum(within).alias("w"), F.sum(n).alias("n")).first()
    if not row["n"]:
        return 1.0
    spread = max((row["b"] - row["w"]) / row["n"], 1e-9)
    return float(np.clip(overall * (1 - overall) / spread - 1, 1.0, 1e6))


def path_rates(scored: DataFrame) -> tuple[DataFrame, list[float]]:
    """``(_host, _path, low_rate, toxic_rate)`` and the global rates.

    ``scored`` has ``_host``, ``_path`` and the evidence of all documents.
    """
    p = {t: 1 / (1 + F.exp(-F.col(f"{t}_evidence"))) for t in TARGETS}
    paths = staged(scored.groupBy("_host", "_path").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(p[t]).alias(f"{t}_sum") for t in TARGETS],
        *[F.sum(p[t] * p[t]).alias(f"{t}_squares") for t in TARGETS],
    ))
    hosts = paths.groupBy("_host").agg(
        *[F.sum(c).alias(c) for c in paths.columns[2:]])
    total = paths.agg(*[F.sum(c).alias(c) for c in paths.columns[2:]]).first()
    overall = [min(max((total[f"{t}_sum"] or 0) / max(total["n"] or 0, 1), 1e-6), 1 - 1e-6)
               for t in TARGETS]
    for t, g in zip(TARGETS, overall):
        rated = hosts.withColumn("_r", F.col(f"{t}_sum") / F.col("n"))
        k = _strength(rated, "_r", "n", f"{t}_squares", g)
        hosts = hosts.withColumn(f"_{t}_host", (k * g + F.col(f"{t}_sum")) / (k + F.col("n")))
    paths = paths.join(hosts.select("_host", "_low_host", "_toxic_host"), "_host")
    for t, g in zip(TARGETS, overall):
        rated = paths.withColumn("_r", F.col(f"{t}_sum") / F.col("n"))
        k = _strength(rated, "_r", "n", f"{t}_squares", g)
        paths = paths.withColumn(
            f"{t}_rate", (k * F.col(f"_{t}_host") + F.col(f"{t}_sum")) / (k + F.col("n")))
    return staged(paths.select("_host", "_path", "low_rate", "toxic_rate")), overall


def _logit(p):
    return F.log(p / (1 - p))


def judge_documents(
    docs: DataFrame, labels: DataFrame, keep: Sequence[str] | None = None, text: str = "text",
    host: str = "source", path: Sequence[str] = ("lang",), doc_id: str = "doc_id",
    max_labelled: int = 8_000, most_features: int = 1_000, limits: Sequence[float] = (0.5, 0.25),
    seed: int = 3,
) -> DataFrame:
    """``keep`` columns (default: all), the log odds ``low_evidence`` and
    ``toxic_evidence``, the path's ``low_rate`` and ``toxic_rate``, the posterior
    probabilities ``p_low`` and ``p_toxic``, and ``kept``: neither is above its limit.

    The models see ``max_labelled`` labelled rows at most; everything else, all
    documents. Null text is empty text, null hosts and path parts are groups of
    their own, rows that repeat get equal verdicts, an empty table gives an
    empty one. Without labels, evidence is constant and all is kept. Input
    columns named like an added one are left out.
    """
    kept = without(docs.select(*keep) if keep else docs, *ADDED, "_host", "_path")
    models = train(docs, labels, text, doc_id, max_labelled, most_features, seed)
    part = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in (host, *path)]
    carried = docs.select(
        *quoted(kept), part[0].alias("_host"), F.concat_ws("/", *part[1:]).alias("_path"),
        F.col(text).alias("_text"))
    scored = staged(with_evidence(carried, F.col("_text"), carried.drop("_text"), models))
    rates, overall = path_rates(scored)
    joined = scored.join(rates, ["_host", "_path"])
    for t, g in zip(TARGETS, overall):
        odds = F.col(f"{t}_evidence") + _logit(F.col(f"{t}_rate")) - float(np.log(g / (1 - g)))
        joined = joined.withColumn(f"p_{t}", 1 / (1 + F.exp(-odds)))
    return joined.select(*quoted(kept), *ADDED[:6]).withColumn(
        "kept", (F.col("p_low") <= limits[0]) & (F.col("p_toxic") <= limits[1]))

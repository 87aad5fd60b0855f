"""The site classifier: held-out accuracy and the shrinkage by hand."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from framelark.llm import site_quality as site

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where("doc_id % 2 = 0")
    rows = site.judge_documents(docs, half, ["doc_id"]).join(
        labels.where("doc_id % 2 = 1"), "doc_id").collect()
    toxic = [r.kept for r in rows if r.toxic == 1]
    low = [r.kept for r in rows if r.quality == 0]
    clean = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    assert np.mean(toxic) < 0.08 and np.mean(low) < 0.08 and np.mean(clean) > 0.99


def test_features_are_a_set_per_text():
    texts = ["a b a", "", None, "stupidly Stupid", "b"]
    found, bounds = site.document_features(pa.array(texts))
    for d, text in enumerate(texts):
        alone = site.document_features(pa.array([text]))[0]
        assert sorted(found[bounds[d]:bounds[d + 1]]) == sorted(alone) and len(set(alone)) == len(alone)
    wanted = np.zeros(4 << site.BITS, bool)
    wanted[found[:2]] = True
    assert set(site.document_features(pa.array(texts), wanted)[0]) >= set(found[:2])


def test_logistic_finds_the_telling_word():
    draw = np.random.default_rng(0)
    words = [[f"w{i}" for i in draw.integers(0, 300, 40)] for _ in range(400)]
    y = np.array([d % 4 == 0 for d in range(400)], float)
    texts = [" ".join(w + ["scum"] * bool(t)) for w, t in zip(words, y)]
    found, bounds = site.document_features(pa.array(texts))
    odds = site.evidence(found, bounds, site.fit(found, bounds, y, 50))
    assert ((odds > 0) == (y > 0)).all()


def shrunk(groups, parent, overall):
    """Brute force of the rates: {group: rate} from {group: list of p}."""
    n = {g: len(p) for g, p in groups.items()}
    mean = {g: np.mean(p) for g, p in groups.items()}
    b = sum((mean[g] - overall) ** 2 * n[g] for g in groups)
    w = sum(np.var(groups[g]) for g in groups)
    k = np.clip(overall * (1 - overall) / max((b - w) / sum(n.values()), 1e-9) - 1, 1, 1e6)
    return {g: (k * parent[g] + sum(groups[g])) / (k + n[g]) for g in groups}


def test_rates_shrink_to_host_and_world(spark):
    draw = np.random.default_rng(4)
    rows = [(f"h{h}", f"p{p}", float(draw.normal(h - 2, 1)), float(draw.normal(p, 1)))
            for h in range(5) for p in range(3) for _ in range(1 if p == 2 else 30)]
    scored = spark.createDataFrame(
        rows, "_host string, _path string, low_evidence double, toxic_evidence double")
    rates, overall = site.path_rates(scored)
    got = {(r["_host"], r["_path"]): r for r in rates.collect()}
    for i, t in enumerate(("low", "toxic")):
        p = [1 / (1 + np.exp(-r[2 + i])) for r in rows]
        assert abs(np.mean(p) - overall[i]) < 1e-9
        hosts, paths = {}, {}
        for r, v in zip(rows, p):
            hosts.setdefault(r[0], []).append(v)
            paths.setdefault(r[:2], []).append(v)
        up = shrunk(hosts, dict.fromkeys(hosts, np.mean(p)), np.mean(p))
        want = shrunk(paths, {g: up[g[0]] for g in paths}, np.mean(p))
        assert all(abs(want[g] - got[g][f"{t}_rate"]) < 1e-9 for g in want)


def test_odd_rows(make_docs, spark):
    labels = spark.createDataFrame(
        [(0, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 1), (0, 1, 0)],
        "doc_id long, quality int, toxic int")
    texts = [(0, "fine words"), (1, "BAD!! $$$"), (2, "scum"), (None, None), (5, ""),
             (5, ""), (6, "x" * 300_000)]
    docs = make_docs(texts).withColumn("kept", F.lit("clash")).withColumn(
        "source", F.lit(None).cast("string"))
    rows = site.judge_documents(docs, labels).collect()
    assert len(rows) == 7 and all(0 <= r.p_low <= 1 and 0 <= r.p_toxic <= 1 for r in rows)
    assert len({(r.p_low, r.p_toxic, r.kept) for r in rows if r.doc_id == 5}) == 1
    none = site.judge_documents(docs, labels.where("false")).collect()
    assert all(r.kept for r in none)
    assert site.judge_documents(docs.where("false"), labels).count() == 0

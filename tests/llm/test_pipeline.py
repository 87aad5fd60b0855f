"""The pipeline against brute force, stage by stage, on its own inputs."""

from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline as pipeline
from framelark.llm.site_quality import judge_documents
from framelark.llm.source_mixing import mix
from test_overlap_join import brute as brute_components
from test_spaced_seeds import brute as brute_leaks

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs.collect()]
    for _, stage in pipeline.STAGES:
        docs = pipeline.staged(stage(spark, docs, DATA))
        out.append(docs.collect())
    return out


def ids(rows):
    return Counter(r.doc_id for r in rows)


def test_stages_keep_what_brute_force_keeps(spark, results):
    start, good, distinct, clean, mixed, sharded = results
    judged = judge_documents(
        spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    assert ids(good) == ids(r for r in judged.collect() if r.p_low <= .5 and r.p_toxic <= .25)
    groups = brute_components([(r.doc_id, r.text) for r in good])
    assert ids(distinct) == Counter({d: 1 for d, _, c in groups if d == c})
    items = duckdb.sql(f"select item_id, text from '{DATA}/benchmark.parquet'").fetchall()
    leaks = {d for d, _ in brute_leaks([(r.doc_id, r.text) for r in distinct], items)}
    assert ids(clean) == ids(r for r in distinct if r.doc_id not in leaks)
    assert len(start) > len(good) > len(distinct) > len(clean) > 0
    copies = {r.doc_id: r.copies for r in mix(
        spark.createDataFrame(clean, spark.read.parquet(f"{DATA}/documents.parquet").schema)).collect()}
    assert ids(mixed) == Counter({d: n for d, n in copies.items() if n})
    assert ids(sharded) == ids(mixed)


def test_columns_and_shards(results):
    assert all(list(rows[0].asDict()) == COLUMNS for rows in results[:5])
    assert list(results[5][0].asDict()) == [*COLUMNS, "shard", "slot"]
    texts = {r.doc_id: r.text for r in results[0]}
    slots = defaultdict(list)
    for r in results[5]:
        assert texts[r.doc_id] == r.text
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 8


def test_run_is_the_stages_in_turn(spark, results):
    rows = pipeline.run(spark, DATA).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, results[-1]), key=str)


@pytest.mark.parametrize("number", range(5))
def test_stage_of_odd_rows(spark, make_docs, number):
    docs = make_docs([(None, None), (1, ""), (1, ""), (2, "word " * 50_000), (2, None)])
    stage = pipeline.STAGES[number][1]
    assert stage(spark, docs, DATA).columns[:5] == COLUMNS
    assert {r.doc_id for r in stage(spark, docs, DATA).collect()} <= {None, 1, 2}
    assert stage(spark, docs.where("false"), DATA).count() == 0

"""Document pipeline: five stages, each on all that the one before it kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each result as Parquet below the shared checkpoint folder and reads it
back as the next stage's ``docs``, so a lost executor repeats one stage at most.
All stages but the last return the columns of ``documents``; a mixed document
comes out as often as the mix takes it, and the last adds ``shard`` and ``slot``.
"""

from pyspark.sql import functions as F

from framelark.llm.common import read, staged
from framelark.llm.external_shuffle import external_shuffle
from framelark.llm.overlap_join import one_of_each
from framelark.llm.site_quality import judge_documents
from framelark.llm.source_mixing import mix
from framelark.llm.spaced_seeds import decontaminate


#: Columns that the stages read; the operators see others under plain names.
USED = ("doc_id", "text", "lang", "source", "n_chars")


def apart(docs):
    """``docs`` with columns no stage reads renamed, so that they meet no other."""
    return docs.toDF(*[c if c in USED else f"extra{i}" for i, c in enumerate(docs.columns)])


def keep_quality(spark, docs, sf_dir):
    """Documents that the site quality classifier keeps."""
    rows = apart(docs)
    judged = judge_documents(rows, read(spark, sf_dir, "labels"))
    return judged.where("kept").select(*rows.columns).toDF(*docs.columns)


def keep_distinct(spark, docs, sf_dir):
    """One document of each group of near duplicates, the one of the smallest id."""
    return one_of_each(docs)


def keep_uncontaminated(spark, docs, sf_dir):
    """Documents without an overlap with the benchmark."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs, sf_dir):
    """Each document as many times as the target weights take it."""
    rows = apart(docs)
    taken = mix(rows).where("copies > 0")
    return taken.select(
        *rows.columns, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy")
    ).select(*rows.columns).toDF(*docs.columns)


def shard_shuffled(spark, docs, sf_dir):
    """All rows in eight shards, shuffled."""
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long")
    return external_shuffle(docs, 8, size)


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", keep_distinct),
    ("benchmark_decontamination", keep_uncontaminated),
    ("mixing_to_target_weights", mix_sources),
    ("sharding", shard_shuffled),
]

#: Two of the stages train models or search; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs

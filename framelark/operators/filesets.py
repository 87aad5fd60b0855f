"""Filesets: triphone coverage, the covering split, set bookkeeping.

``index`` tables hold distinct ``(utt, triphone)`` rows and ``sets`` tables
one ``(utt, set_name)`` row per utterance.
"""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelark.functions.scalars import natural_key
from framelark.operators.exchange import HOT, even_out, indexed, placed
from framelark.operators.frames import SALTS, number_rows, salted_join
from framelark.session import staged, unstaged

SETS = ("train", "validation", "test")


def document_frequency(index: DataFrame, limit: int = 9) -> DataFrame:
    """Triphones found in at least ``limit`` utterances."""
    return (
        index.groupBy("triphone").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= limit)
    )


#: No more triphones than these count as hot.
HOT_KEYS = 100_000


def _numbered_index(index: DataFrame, limit: int) -> DataFrame:
    """The kept index with a ``_number`` for each triphone."""
    kept = staged(document_frequency(index, limit).withColumn(
        "_number", F.monotonically_increasing_id()))
    total = kept.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = F.col("n") > max(HOT, total // HOT_KEYS)
    # Only hot triphones are copied, one to each salt.
    last = F.when(hot, SALTS - 1).otherwise(0)
    copies = kept.select("triphone", "_number", F.explode(F.sequence(F.lit(0), last)).alias("_salt"))
    spread = F.pmod(F.xxhash64("utt"), F.lit(SALTS)).cast("int")
    marked = index.join(
        F.broadcast(kept.where(hot).select("triphone", F.lit(True).alias("_hot"))), "triphone", "left")
    return marked.withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(0)).join(
        copies, ["triphone", "_salt"]).select(*index.columns, "_number")


def kept_index(index: DataFrame, limit: int = 9) -> DataFrame:
    """The index reduced to the triphones worth covering."""
    return _numbered_index(index, limit).drop("_number")


def gains(index: DataFrame, coverage: DataFrame, sets: Sequence[str] = SETS) -> DataFrame:
    """Per utterance and set, how many of its triphones the set lacks.

    ``coverage`` holds distinct ``(set_name, triphone)`` rows. A triphone's
    sets are folded into one flag vector, so each index row joins once.
    """
    flags = coverage.groupBy("triphone").agg(
        *[F.max(F.col("set_name") == s).alias(f"_has{i}") for i, s in enumerate(sets)]
    )
    missing = [
        F.sum(1 - F.coalesce(F.col(f"_has{i}"), F.lit(False)).cast("int")).alias(f"gain_{s}")
        for i, s in enumerate(sets)
    ]
    flagged = salted_join(index, flags, ["triphone"], "left", spread=F.col("utt"))
    return flagged.groupBy("utt").agg(*missing)


def best_set(gain_table: DataFrame, sets: Sequence[str] = SETS) -> DataFrame:
    """The set that gains most; the first one wins a tie."""
    top = F.greatest(*[F.col(f"gain_{s}") for s in sets])
    choice = F.coalesce(
        *[F.when(F.col(f"gain_{s}") == top, F.lit(s)) for s in sets]
    )
    return gain_table.withColumn("best", choice)


def with_set(index: DataFrame, sets: DataFrame) -> DataFrame:
    return salted_join(index, sets, ["utt"], spread=F.col("triphone"))


def set_counts(indexed: DataFrame) -> DataFrame:
    """Utterances per (set, triphone)."""
    return indexed.groupBy("set_name", "triphone").agg(F.count(F.lit(1)).alias("n_utts"))


def uncovered(indexed: DataFrame, sets: Sequence[str] = SETS) -> DataFrame:
    """Triphones that some set lacks, with the number of sets that have them."""
    return (
        indexed.groupBy("triphone")
        .agg(F.count_distinct("set_name").alias("n_sets"))
        .where(F.col("n_sets") < len(sets))
    )


def movable(indexed: DataFrame) -> DataFrame:
    """Per utterance, whether each of its triphones occurs again in its set."""
    counts = set_counts(indexed)
    return (
        salted_join(indexed, counts, ["set_name", "triphone"], spread=F.col("utt"))
        .groupBy("utt", "set_name")
        .agg((F.min("n_utts") > 1).alias("movable"))
    )


def target_sizes(n_total: int, pct_train: float = 0.7) -> dict[str, int]:
    """Train takes the ceiling, validation half of the rest, test what is left."""
    train = math.ceil(n_total * pct_train)
    validation = (n_total - train) // 2
    return dict(zip(SETS, (train, validation, n_total - train - validation)))


def size_table(sets: DataFrame, pct_train: float = 0.7) -> DataFrame:
    """Present and target size of each set."""
    total = sets.agg(F.count(F.lit(1)).alias("n")).scalar()
    present = sets.groupBy("set_name").agg(F.count(F.lit(1)).alias("n_present"))
    train = F.ceil(total * F.lit(pct_train))
    validation = F.floor((total - train) / 2)
    target = (
        F.when(F.col("set_name") == "train", train)
        .when(F.col("set_name") == "validation", validation)
        .otherwise(total - train - validation)
    )
    return present.withColumn("n_target", target.cast("bigint"))


# --- the covering split -----------------------------------------------------

PLACES = 4_000_000_000


def _draw(utt: Column, seed: int) -> Column:
    """A reproducible draw in [0, PLACES) that depends on the name alone."""
    return F.pmod(F.xxhash64(utt, F.lit(seed)), F.lit(PLACES))


def _numbered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number along the draw; its leading digits are the buckets."""
    bucket = F.floor(F.col("draw") / (PLACES // 4096))
    return number_rows(df, keys, ["draw", "utt"], bucket, "rank", "bigint")


def _holders(kept: DataFrame, sets: DataFrame) -> DataFrame:
    """Per triphone and set, the number of utterances and the witness: one
    utterance that keeps the triphone covered there.

    Utterances rich in triphones come first, so few are needed; all others may
    move freely without any triphone losing its set.
    """
    first = F.struct(-F.col("n_tri"), F.col("draw"), F.col("utt"))
    here = [F.col("set_name") == s for s in SETS]
    return staged(
        indexed(kept, sets).groupBy("triphone").agg(
            *[F.sum(h.cast("int")).alias(f"n_{s}") for s, h in zip(SETS, here)],
            *[F.min(F.when(h, first)).alias(f"w_{s}") for s, h in zip(SETS, here)],
        )
    )


def _bound(holders: DataFrame) -> DataFrame:
    """The witnesses, with the number of triphones only they have in their set."""
    witness = [
        F.when(F.col(f"n_{s}") > 0, F.struct(
            F.col(f"w_{s}.utt").alias("utt"), (F.col(f"n_{s}") == 1).cast("int").alias("alone")
        )) for s in SETS
    ]
    rows = holders.select(F.explode(F.array_compact(F.array(*witness))).alias("w"))
    return rows.groupBy(F.col("w.utt").alias("utt")).agg(F.sum("w.alone").alias("n_alone"))


def _repair(kept: DataFrame, sets: DataFrame, holders: DataFrame, turn: int) -> DataFrame:
    """Give each missing (set, triphone) an utterance that has it.

    Utterances no set depends on come first. A triphone found in none of them
    takes the one whose loss hurts least; what that uncovers is for the next
    round, which ranks by another draw.
    """
    lacking = holders.select("triphone", _lacking().alias("wanted"))
    having = kept.join(lacking.select("triphone").distinct(), "triphone", "left_semi")
    offers = indexed(having, sets).join(lacking, "triphone").join(
        _bound(holders), "utt", "left"
    )
    rank = F.struct(
        F.col("n_alone").isNotNull(), F.coalesce("n_alone", F.lit(0)), -F.col("n_tri"),
        F.xxhash64("draw", F.lit(turn)), F.col("utt"),
    )
    taken = offers.groupBy("wanted", "triphone").agg(F.min(rank).alias("w"))
    # One utterance asked for by several sets goes where it fills most holes.
    moves = (
        taken.groupBy(F.col("w.utt").alias("utt"), "wanted")
        .agg(F.count(F.lit(1)).alias("gain"))
        .groupBy("utt")
        .agg(F.max_by("wanted", F.struct(F.col("gain"), F.col("wanted"))).alias("_to"))
    )
    moved = sets.join(moves, "utt", "left")
    return staged(
        moved.withColumn("set_name", F.coalesce("_to", "set_name")).drop("_to")
    )


def _lacking() -> Column:
    """The sets a triphone is missing from, one row each."""
    return F.explode(F.array_compact(
        F.array(*[F.when(F.col(f"n_{s}") == 0, s) for s in SETS])
    ))


def split_corpus(
    index: DataFrame,
    utterances: DataFrame,
    pct_train: float = 0.7,
    limit: int = 9,
    seed: int = 0,
    max_rounds: int = 20,
) -> DataFrame:
    """Split utterances so that each triphone found in ``limit`` of them occurs
    in train, validation and test, with the asked sizes. Returns ``(utt, set_name)``.

    Utterances are dealt out by a seeded draw in the asked proportions. While a
    set lacks a triphone, an utterance that has it is moved there, if possible
    one no set depends on. Last, utterances that no set depends on, and
    exchanges that free more of them, even out the sizes. Every step is a few joins and aggregations over the whole index.
    """
    if not 0 < pct_train < 1:
        raise ValueError(f"pct_train must lie between 0 and 1, not {pct_train}")
    if limit < len(SETS):
        raise ValueError("limit must be at least 3")
    numbered = staged(_numbered_index(index, limit).select("utt", F.col("_number").alias("triphone")))
    rich = numbered.groupBy("utt").agg(F.count(F.lit(1)).alias("n_tri"))
    base = utterances.select("utt").distinct().join(rich, "utt", "left")
    base = base.select(
        "utt", F.coalesce("n_tri", F.lit(0)).alias("n_tri"), _draw(F.col("utt"), seed).alias("draw")
    )
    drawn = staged(base)
    base = staged(_numbered(drawn, []))
    unstaged(drawn)
    kept = placed(numbered, rich)
    unstaged(numbered)
    sizes = target_sizes(base.count(), pct_train)
    if min(sizes.values()) == 0 and not kept.isEmpty():
        raise RuntimeError(f"an empty set covers no triphone: {sizes}")
    n_train, n_fit = sizes["train"], sizes["train"] + sizes["validation"]
    sets = base.withColumn(
        "set_name",
        F.when(F.col("rank") < n_train, "train")
        .when(F.col("rank") < n_fit, "validation").otherwise("test"),
    ).drop("rank")

    for turn in range(max_rounds):
        holders = _holders(kept, sets)
        if holders.select(_lacking()).limit(1).count() == 0:
            unstaged(holders)
            sets = even_out(kept, sets, sizes, PLACES // 4096, 3 * max_rounds)
            return sets.select("utt", "set_name")
        before, sets = sets, _repair(kept, sets, holders, turn)
        unstaged(holders, before)
    raise RuntimeError(f"no covering split within {max_rounds} rounds; raise the limit")


def same_speaker_rank(utterances: DataFrame) -> DataFrame:
    """Rank of each ``(speaker, utt)`` in its speaker's list, from 0."""
    return number_rows(
        utterances, ["speaker"], ["utt"], None, "rank", "bigint", null_keys=True)


def generalize_to_speakers(sets: DataFrame, ranks: DataFrame) -> DataFrame:
    """Put the i-th utterance of every speaker into the set of rank i."""
    return ranks.join(sets.select("rank", "set_name"), "rank")


def in_fileset(rows: DataFrame, sets: DataFrame, set_name: str | None) -> DataFrame:
    """Rows of the utterances of one set; all of them when none is named."""
    if set_name is None:
        return rows
    chosen = sets.where(F.col("set_name") == set_name).select("utt")
    return salted_join(rows, chosen, ["utt"], "left_semi", spread=F.xxhash64(*rows.columns))


def adjust_provided(utterances: DataFrame, provided: DataFrame) -> DataFrame:
    """Carry distributed filesets over to utterances split after the fact.

    The letters a-f at either end of a name tell the parts of one recording
    apart; the results are named ``<set>_initial``.
    """
    stem = F.regexp_replace("utt", "^[abcdef]+|[abcdef]+$", "")
    names = provided.select(F.col("utt").alias("_stem"), "set_name").distinct()
    return (
        utterances.select("utt", stem.alias("_stem")).join(names, "_stem")
        .select("utt", F.concat("set_name", F.lit("_initial")).alias("set_name"))
    )


def natural_order(rows: DataFrame, column: str) -> DataFrame:
    return rows.orderBy(natural_key(F.col(column)), column)


def seeded_order(rows: DataFrame, column: str, seed: int) -> DataFrame:
    """A reproducible random order, the same under any partitioning."""
    return rows.orderBy(F.xxhash64(F.col(column), F.lit(seed)), column)


def mini_batch(utterances: DataFrame, size: int, seed: int) -> DataFrame:
    """``size`` utterances drawn at random."""
    return seeded_order(utterances, "utt", seed).limit(size)

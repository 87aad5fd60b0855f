"""Mixing sources to target weights by hash-threshold histograms.

A document's place is a fixed 60-bit hash of its id. What a source may give is
a budget of words; the documents below a hash threshold fill it. The threshold
is found without sorting: words are summed by (source, leading hash bits), the
running sums show the one bucket that the budget ends in, and only the rows of
that bucket are split by the next bits, until it holds a single hash. A larger
budget has a larger threshold, so budgets of one source are nested.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelark.llm.common import quoted, staged, without, word_count

HASH_BITS = 60
STEP_BITS = 12


def place(doc_id: Column, seed: int) -> Column:
    """The leading 60 bits of an MD5 over seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3,
) -> DataFrame:
    """Targets of the sources: ``(source, source_size, target)``.

    ``sizes`` has one row ``(source, source_size)`` per source. Sources in
    code-point order, null last, weigh ``weights`` in turn and share the sum of
    all sizes; none gets more than ``cap`` times its size, and what is above
    is shared again by weight. Sources reach their cap in the order of size
    over weight, so the level of the others follows from running sums.
    """
    ranked = sizes.withColumn("_r", F.row_number().over(
        Window.orderBy(F.col("source").isNull(), "source")
    ) - 1).withColumn(
        "_w", F.element_at(F.array(*[F.lit(w) for w in weights]),
                           (F.col("_r") % len(weights) + 1).cast("int")).cast("long")
    )
    ratio = F.col("source_size") / F.col("_w")
    through = Window.orderBy(ratio, "_r")
    before = through.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    # Words and weight left once all sources of a smaller ratio are at their cap.
    left = F.sum("source_size").over(everything) - cap * F.coalesce(
        F.sum("source_size").over(before), F.lit(0))
    weight = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    level = left / weight
    below = ranked.withColumn("_level", level).withColumn(
        "_fits", F.col("_level") * F.col("_w") <= cap * F.col("source_size")
    )
    # The first source that stays below its cap sets the level of the rest.
    chosen = F.min(F.when(F.col("_fits"), F.struct(ratio, F.col("_r"), F.col("_level")))).over(
        everything)
    return below.withColumn("_level", chosen["_level"]).select(
        "source", "source_size",
        F.least(
            (cap * F.col("source_size")).cast("double"),
            F.coalesce(F.col("_level") * F.col("_w"), (cap * F.col("source_size")).cast("double")),
        ).alias("target"),
    )


def thresholds(
    sized: DataFrame, budgets: DataFrame, step_bits: int = STEP_BITS,
) -> DataFrame:
    """``(skey, budget_no, edge, with_edge)``: take hashes below ``edge``, and
    ``edge`` itself if ``with_edge``, to come nearest to the budget.

    ``sized`` has rows ``(skey, h, size)``, ``budgets`` ``(skey, budget_no, budget)``.
    Each level reads only the rows of the buckets that a budget ends in.
    """
    state = budgets.select("skey", "budget_no", F.col("budget").alias("rest"),
                           F.lit(0).cast("long").alias("prefix"))
    shift = HASH_BITS
    while True:
        step = min(step_bits, shift)
        last_shift, shift = shift, shift - step
        rows = sized.join(state, "skey").where(
            F.shiftright("h", last_shift) == F.col("prefix")
        ) if last_shift < HASH_BITS else sized.join(state, "skey")
        cells = rows.groupBy(
            "skey", "budget_no", "rest", F.shiftright("h", shift).alias("prefix")
        ).agg(F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high"))
        along = Window.partitionBy("skey", "budget_no").orderBy("prefix").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        summed = cells.withColumn("through", F.sum("words").over(along))
        # The bucket that the budget ends in; the last one if it takes all.
        ends = summed.groupBy("skey", "budget_no").agg(
            F.min(F.when(F.col("through") > F.col("rest"), F.struct(
                "prefix", "rest", "words", "through", "low", "high"))).alias("cut"),
            F.max(F.struct("prefix", "rest", "words", "through", "low", "high")).alias("last"),
        )
        found = staged(ends.select(
            "skey", "budget_no", F.coalesce("cut", "last").alias("at")
        ).select(
            "skey", "budget_no", "at.prefix", "at.low", "at.high", "at.words",
            (F.col("at.rest") - F.col("at.through") + F.col("at.words")).alias("rest"),
        ))
        if shift == 0 or found.where("low < high").isEmpty():
            return found.select(
                "skey", "budget_no", F.col("low").alias("edge"),
                (F.col("words") - F.col("rest") < F.col("rest")).alias("with_edge"),
            )
        state = found.select("skey", "budget_no", "rest", "prefix")


def mix(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", size: Column | None = None,
    weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: int = 11,
) -> DataFrame:
    """``docs`` plus ``size``, ``source_size``, ``target``, ``taken`` and ``copies``.

    ``size`` defaults to the words of column ``text``. A source whose target is
    t times its size gives every document floor(t) times, and those below its
    hash threshold once more; ``taken`` = ``copies`` x ``size``. A document too
    large for what is left is taken if that ends nearer to the target. Rows
    of one id have one hash and go together; null ids are one id, null is a
    source of its own, an empty table gives an empty one, a source without
    words takes nothing. Columns named like an added one are replaced.
    """
    size = word_count(F.col("text")) if size is None else size
    added = ("size", "source_size", "target", "taken", "copies")
    skey = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    rows = docs.select(
        F.struct(*quoted(docs)).alias("_row"), size.cast("long").alias("size"),
        skey.alias("skey"), place(F.col(doc_id), seed).alias("h"),
    )
    sized = staged(rows.select("skey", "h", "size"))
    sums = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    targets = staged(source_targets(sums.select(
        F.when(F.col("skey") != "n", F.expr("substring(skey, 2)")).alias("source"), "source_size",
    ), weights, cap).select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("skey"),
        "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(0).cast("long").alias("whole"),
    ))
    budgets = targets.select(
        "skey", F.lit(0).alias("budget_no"),
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"),
    )
    edges = thresholds(sized, budgets)
    plan = staged(targets.join(edges.drop("budget_no"), "skey"))
    once_more = (F.col("h") < F.col("edge")) | ((F.col("h") == F.col("edge")) & F.col("with_edge"))
    copies = (F.col("whole") + once_more.cast("long")).alias("copies")
    kept = [c for c in quoted(without(docs, *added))]
    return rows.join(plan, "skey").select(
        *[F.col(f"_row.{c}") for c in kept], "size", "source_size", "target",
        (F.col("size") * copies).alias("taken"), copies,
    )

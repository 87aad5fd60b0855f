"""Line dedup by a template tree of fixed depth, in DataFrame functions only.

A line goes to a leaf by its number of tokens and its leading tokens; tokens
with a digit are variable from the start. Within a leaf a position keeps a token
that ``min_docs`` documents have there and is variable otherwise, so lines that
differ in their fields share a template. A template that enough documents have,
and of which enough tokens are constant, recurs: its lines are dropped, but for
the first one (smallest document, then line) if ``keep_first``.

Equal lines are one row before tokens are counted, with the documents they come
from as a count and a smallest place, so a line of a third of all documents
costs one row per task. Lines of leaves in fewer than ``min_docs`` documents
are left alone without a look at their tokens. Texts are parsed once, and the
lines go on as staged rows of a string and hashes. No join side that grows with
the input is broadcast, at any size, so the plan is the same for all.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelark.llm.common import quoted, staged, without

VARIABLE = "<*>"
#: Words of 64 bits that tell leaves apart; bounds what is broadcast.
SLOTS = 1 << 19
#: A whole word with a digit.
NUMBER = r"(?<![^\x20\x09-\x0D])[^0-9\x20\x09-\x0D]*+[0-9][^\x20\x09-\x0D]*+"
#: White space inside a line that is not one space.
WIDE_GAP = r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]"
DIGIT_OR_SPACE = r"[0-9\x09\x0B-\x0D]"
DEPTH = 2
MIN_DOCS = 3
SIMILARITY = 0.6
LEAST_TOKENS = 3


def masked(text: Column) -> Column:
    """The text with a word that has a digit as ``VARIABLE`` and every gap inside
    a line as one space.

    A text without a digit and without such a gap is not searched for words or gaps.
    """
    numbers = F.regexp_replace(text, NUMBER, VARIABLE)
    any_ = F.contains(text, F.lit("  ")) | text.rlike(DIGIT_OR_SPACE)
    return F.when(any_, F.regexp_replace(numbers, WIDE_GAP, " ")).otherwise(text)


def document_lines(docs: DataFrame, doc_id: str, text: str, depth: int) -> DataFrame:
    """Lines of at least ``LEAST_TOKENS`` words, with leaf and hashes.

    ``t`` is the masked line as one string, a fraction of an array of its words
    in a shuffle; ``size`` is their number.
    """
    texts = docs.select(
        F.col(doc_id).alias("doc"), F.xxhash64(doc_id, text).alias("row"),
        F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("lines"))
    # Masked line by line: few have anything to mask. As part of the explosion,
    # so that the filter below does not mask each line again.
    t = texts.select("doc", "row", F.posexplode(
        F.transform("lines", lambda line: F.trim(masked(line)))).alias("line_no", "t"))
    gaps = F.octet_length("t") - F.octet_length(F.replace("t", F.lit(" "), F.lit("")))
    return t.withColumn("size", gaps + 1).where(F.col("size") >= LEAST_TOKENS).select(
        "doc", "row", "line_no", "t", "size",
        F.xxhash64("size", F.substring_index("t", " ", depth)).alias("leaf"),
        F.xxhash64(F.lit(1), "t").alias("h1"), F.xxhash64(F.lit(2), "t").alias("h2"),
    )


def shared_leaves(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The lines of leaves that ``min_docs`` documents have.

    Most lines are of other leaves. They are told by one bit for many leaves, in
    ``SLOTS`` words of 64 bits at most, before the rest is joined with the leaves.
    """
    leaves = staged(lines.select("leaf", "doc").distinct().groupBy("leaf").agg(
        F.count(F.lit(1)).alias("m")).where(F.col("m") >= min_docs).select("leaf"))
    place = F.floor(F.pmod("leaf", F.lit(64 * SLOTS)) / 64).alias("slot")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("leaf", F.lit(64)).cast("int"))
    marks = leaves.groupBy(place).agg(F.bit_or(bit).alias("bits"))
    able = lines.select("*", place).join(F.broadcast(marks), "slot").where(
        F.col("bits").bitwiseAND(bit) != 0).drop("slot", "bits")
    return able.join(leaves.hint("merge"), "leaf")


def recurring_lines(
    lines: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY,
) -> DataFrame:
    """``(h1, h2, leaf, template, held, n_docs, first)`` of distinct lines (of
    ``shared_leaves``) whose template recurs; ``held`` has its constant tokens,
    ``first`` its first place.
    """
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "line_no")
    per_doc = lines.groupBy("leaf", "h1", "h2", "doc").agg(
        F.first("t").alias("t"), F.first("size").alias("size"), F.min(place).alias("place"))
    busy = staged(per_doc.groupBy("leaf", "h1", "h2").agg(
        F.first("t").alias("t"), F.first("size").alias("size"), F.min("place").alias("place"),
        F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()))
    cells = busy.select(
        "leaf", "id", "n", F.posexplode(F.split("t", " ")).alias("at", "token")).where(
        F.col("token") != VARIABLE)
    constant = cells.groupBy("leaf", "at", "token").agg(F.sum("n").alias("m")).where(
        F.col("m") >= min_docs).drop("m")
    held = cells.join(constant.hint("merge"), ["leaf", "at", "token"], "left_semi").groupBy(
        "id"
    ).agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("held"))
    found = staged(busy.drop("t").join(held.hint("merge"), "id").where(
        F.size("held") >= similarity * F.col("size")
    ).select("leaf", "h1", "h2", "n", "place", "held", F.xxhash64("held").alias("template")))
    groups = found.groupBy("leaf", "template").agg(
        F.sum("n").alias("n_docs"), F.min("place").alias("first")
    ).where(F.col("n_docs") >= min_docs)
    return found.drop("n", "place").join(groups.hint("merge"), ["leaf", "template"])


def drop_templates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH,
    min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, keep_first: bool = True,
) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept``, the text without the
    dropped lines.

    Lines of fewer than ``LEAST_TOKENS`` words have no fields to speak of and
    stay. A document counts once for each of its distinct lines. Null text has
    no lines and stays null; a null id is one document, the last; rows that
    repeat are treated alike; an empty table gives an empty one. Input columns
    named like an added one are replaced.
    """
    lines = staged(shared_leaves(staged(document_lines(docs, doc_id, text, depth)), min_docs))
    recurring = recurring_lines(lines, min_docs, similarity)
    first = F.lit(keep_first) & F.col("doc").eqNullSafe(F.col("first.doc")) & (
        F.col("line_no") == F.col("first.line_no"))
    gone = staged(lines.select("row", "doc", "line_no", "h1", "h2").join(
        recurring.select("h1", "h2", "first").hint("merge"), ["h1", "h2"]
    ).where(~first).groupBy("row").agg(F.collect_set("line_no").alias("_gone")))
    names = quoted(without(docs, "n_lines", "n_dropped", "kept"))
    rows = docs.withColumn("_row", F.xxhash64(doc_id, text)).join(
        gone.withColumnRenamed("row", "_row").hint("merge"), "_row", "left")
    parts = F.split(F.col(text), "\n")
    none = F.coalesce(F.col("_gone"), F.array().cast("array<int>"))
    return rows.select(
        *names, F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
        F.size(none).cast("long").alias("n_dropped"),
        F.when(F.size(none) == 0, F.col(text)).otherwise(F.array_join(
            F.filter(parts, lambda _, i: ~F.array_contains(none, i)), "\n")).alias("kept"),
    )

"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A fixed mask looks at some token positions of a short span and ignores the
others, so its hash survives substitutions there. The masks below are chosen
such that every ``WINDOW`` aligned tokens that differ in at most
``SUBSTITUTIONS`` places agree under one of them at some offset: no such
overlap is missed. Hashes of the benchmark are joined to those at every token
of every document; around each hit the aligned tokens are compared, and only
windows within the bound count.

The documents are never shuffled: benchmark hashes are broadcast in parts of a
counted, bounded size, one pass over the documents for each part.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelark.llm.common import numbered, staged

#: Lossless for 13 tokens with up to 2 substitutions (fixed values).
MASKS = ("11101011", "110100111")
WINDOW = 13
SUBSTITUTIONS = 2
LEAST_TOKENS = 5
BROADCAST_SEEDS = 200_000
SPLIT = r"[^\p{L}\p{N}]+"


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-case runs of letters and digits."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda t: t != "")
    return F.transform(tokens, lambda t: F.xxhash64(t))


def masked_hash(tokens: str, at: str, mask: str, number: int) -> Column:
    picked = [F.get(tokens, F.col(at) + i) for i, bit in enumerate(mask) if bit == "1"]
    return F.xxhash64(F.lit(number), *picked)


def seeds(benchmark: DataFrame, item_id: str, text: str, masks, window: int) -> DataFrame:
    """``(h, item, width, before, near)``: each masked hash of each item, with the
    item's tokens that share a window with it and where in them the hash lies.

    Items of fewer tokens than a window are compared whole and without
    substitutions, by a mask of their own length.
    """
    items = benchmark.select(
        F.col(item_id).alias("item"), token_hashes(F.col(text)).alias("_t")
    ).withColumn("_n", F.size("_t")).where(F.col("_n") >= LEAST_TOKENS)
    places = items.select("item", "_t", "_n", F.posexplode("_t").alias("_j", "_w"))
    parts = []
    for number, mask in enumerate(masks):
        span = len(mask)
        lo = F.greatest(F.lit(0), F.col("_j") + span - window)
        hi = F.least(F.col("_n"), F.col("_j") + window)
        parts.append(places.where(
            (F.col("_n") >= window) & (F.col("_j") + span <= F.col("_n"))
        ).select(
            masked_hash("_t", "_j", mask, number).alias("h"), "item", F.lit(window).alias("width"),
            (F.col("_j") - lo).alias("before"), F.slice("_t", lo + 1, hi - lo).alias("near"),
        ))
    for n in range(LEAST_TOKENS, window):
        parts.append(items.where(F.col("_n") == n).withColumn("_j", F.lit(0)).select(
            masked_hash("_t", "_j", "1" * n, n + len(masks)).alias("h"), "item",
            F.lit(n).alias("width"), F.lit(0).alias("before"), F.col("_t").alias("near"),
        ))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: Column, text: str = "text",
    item_id: str = "item_id", item_text: str = "text", masks=MASKS, window: int = WINDOW,
    substitutions: int = SUBSTITUTIONS, broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """``(key, item_id, n_windows, best)``: documents that overlap a benchmark item.

    An overlap is ``window`` aligned tokens with at most ``substitutions``
    different; ``n_windows`` counts the document positions at which one starts
    for that item and ``best`` is the most tokens equal in one. Items of fewer
    than ``window`` tokens match whole and exactly, those of fewer than
    ``LEAST_TOKENS`` are no evidence of anything and match nothing. Null texts
    have no tokens. Rows of one ``key`` count as one document.
    """
    planted = staged(seeds(benchmark, item_id, item_text, masks, window))
    widths = [r["width"] for r in planted.select("width").distinct().collect()]  # <= window values
    spans = [(i, m) for i, m in enumerate(masks) if window in widths]
    spans += [(n + len(masks), "1" * n) for n in widths if n < window]
    parts = max(1, -(-planted.count() // broadcast_seeds))
    if not spans:
        spans = [(0, masks[0])]
    tokens = docs.select(key.alias("key"), token_hashes(F.col(text)).alias("_t"))
    places = tokens.where(F.size("_t") >= LEAST_TOKENS).select(
        "key", "_t", F.posexplode("_t").alias("_i", "_w")
    ).select("key", "_t", "_i", F.explode(F.array(
        *[masked_hash("_t", "_i", m, number) for number, m in spans])).alias("h"))
    found = None
    for part in range(parts):
        chosen = planted.where(F.pmod(F.xxhash64("h", "item"), F.lit(parts)) == part)
        hits = places.join(F.broadcast(chosen), "h").select(
            "key", "item", "width", (F.col("_i") - F.col("before")).alias("start"),
            F.size("_t").alias("n"), F.transform("near", lambda t, r: F.coalesce(
                F.get("_t", F.col("_i") - F.col("before") + r) == t, F.lit(False)
            )).alias("equal"),
        )
        verified = hits.select("key", "item", "width", "start", "n", F.posexplode(F.transform(
            F.sequence(F.lit(0), F.size("equal") - F.col("width")),
            lambda s: F.size(F.filter(F.slice("equal", s + 1, F.col("width")), lambda e: e)),
        )).alias("_s", "same")).where(
            (F.col("start") + F.col("_s")).between(0, F.col("n") - F.col("width"))
        ).where(
            F.col("same") >= F.col("width") - F.when(
                F.col("width") == window, substitutions).otherwise(0)
        ).groupBy("key", "item", (F.col("start") + F.col("_s")).alias("at")).agg(
            F.max("same").alias("same"))
        found = verified if found is None else found.unionByName(verified)
    return found.groupBy("key", "item").agg(
        F.countDistinct("at").alias("n_windows"), F.max("same").cast("long").alias("best")
    ).withColumnRenamed("item", item_id)


def row_key(doc_id: str, text: str) -> Column:
    """A document's id, or a digest of its text where that is null."""
    digest = F.concat(F.lit("#"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.coalesce(F.col(doc_id).cast("string"), digest)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """``docs`` without the rows that overlap a benchmark item."""
    rows, at = numbered(docs)
    key = row_key(at[doc_id], at[text])
    marked = staged(contaminated(rows, benchmark, key, at[text], **options).select(
        F.col("key").alias("_key")).distinct())
    return rows.withColumn("_key", key).join(marked, "_key", "left_anti").select(
        *at.values()).toDF(*docs.columns)

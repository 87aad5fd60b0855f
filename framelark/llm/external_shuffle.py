"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters the records by a seeded hash over buckets of a size that
fits a task's memory: one exchange, bucket number = partition number. Pass two
shuffles each bucket by Fisher and Yates (``shuffle`` with a seed) and deals
the records out in their new order. The number of buckets follows the bytes
and rows of the table, so a task's memory does not grow with it.

Law ``rows``: record p of the whole order goes to shard p mod S, slot p div S;
counts are at most one apart and slots have no gaps.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelark.llm.common import offsets, quoted, staged, without

BUCKET_BYTES = 32 << 20
BUCKET_ROWS = 10_000


def external_shuffle(
    records: DataFrame, shards: int = 8, size: Column | None = None, seed: int = 17,
    bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """All columns of ``records`` plus ``shard`` INT and ``slot`` BIGINT.

    ``size`` gives a record's bytes (default: of its string columns). A record
    is hashed with all its columns: null is a value like any other, rows equal
    in every column share a bucket and are interchangeable. Input columns named
    ``shard`` or ``slot`` are replaced. An empty table gives an empty one.
    """
    records = without(records, "shard", "slot")
    names = quoted(records)
    if size is None:
        texts = [c for c, (_, kind) in zip(names, records.dtypes) if kind == "string"]
        size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(8))
    total = records.agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("long")).alias("b")).first()
    buckets = max(1, -(-(total["b"] or 0) // bucket_bytes), -(-total["n"] // bucket_rows))
    key = F.xxhash64(F.lit(seed), *names)
    placed = records.select(
        F.pmod(key, F.lit(buckets)).cast("int").alias("bucket"),
        F.struct(key.alias("key"), F.struct(*names).alias("row")).alias("record"),
    )
    counts = staged(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))
    starts = offsets(counts, "bucket", "n")
    # The start of a bucket travels as one more row of it, which saves a join.
    headed = placed.withColumn("start", F.lit(None).cast("long")).unionByName(
        starts.select(
            F.col("bucket").cast("int"),
            F.lit(None).cast(placed.schema["record"].dataType).alias("record"), "start",
        )
    )
    shuffled = headed.repartitionById(buckets, "bucket").groupBy("bucket").agg(
        F.max("start").alias("start"),
        F.shuffle(F.array_sort(F.collect_list("record")), seed).alias("records"),
    )
    place = F.col("start") + F.col("at")
    return shuffled.select(
        "start", F.posexplode("records").alias("at", "record")
    ).select(
        "record.row.*",
        F.pmod(place, F.lit(shards)).cast("int").alias("shard"),
        F.floor(place / shards).cast("long").alias("slot"),
    )

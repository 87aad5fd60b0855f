"""Tables, running offsets and column helpers of the text operators."""

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelark.session import staged  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add (any letter case)."""
    taken = {n.lower() for n in names}
    return df.select(*[c for c in quoted(df) if c[1:-1].replace("``", "`").lower() not in taken])


def quoted(df: DataFrame) -> list[str]:
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns named c0, c1, .. and where each name went.

    Whatever its columns are called, an operator's own names do not meet them;
    ``toDF(*df.columns)`` gives the names back.
    """
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def word_array(text: Column) -> Column:
    """Words of a text: runs of what is not ASCII white space; none of null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def packed(docs: DataFrame, text: str, key: Column, *more: Column) -> DataFrame:
    """``key``, ``more`` and ``packed``: the text compressed, for a shuffle."""
    rows = docs.select(key.alias("key"), *more, F.col(text).cast("binary").alias("packed"))

    def pack(batches):
        press = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            texts = [press(t or b"") for t in batch.column("packed").to_pylist()]
            columns = [*batch.columns[:-1], pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(pack, rows.schema)


def unpacked(column: pa.Array) -> list[bytes]:
    press = zstandard.ZstdDecompressor()
    return [press.decompress(x) if x else b"" for x in column.to_pylist()]


def offsets(counts: DataFrame, key: str, n: str, block: int = 4096) -> DataFrame:
    """``(key, start)``: sums of ``n`` over all smaller integer keys.

    Two levels: inside blocks of keys, and over the block sums.
    """
    cells = counts.select(F.col(key).cast("long").alias(key), F.col(n).cast("long").alias(n))
    cells = cells.withColumn("_block", F.floor(F.col(key) / block))
    blocks = cells.groupBy("_block").agg(F.sum(n).alias("_sum")).select(
        F.col("_block").alias("_b"),
        F.coalesce(F.sum("_sum").over(
            Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        ), F.lit(0)).alias("_base"),
    )
    inside = Window.partitionBy("_block").orderBy(key).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return cells.withColumn("_in", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(
        blocks, F.col("_block") == F.col("_b")
    ).select(key, (F.col("_base") + F.col("_in")).alias("start"))

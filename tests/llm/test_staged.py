import time

from pyspark.sql import functions as F

from framelark.llm.common import staged


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = blocks.getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}


def test_shuffle_files_go_with_the_write(spark):
    """A joined and grouped table leaves no shuffle file behind, without a further job."""
    before = shuffle_files(spark)
    left = spark.range(5000).withColumn("k", F.col("id") % 700)
    right = spark.range(3000).select((F.col("id") % 700).alias("k"), F.col("id").alias("v"))
    out = staged(left.hint("merge").join(right, "k").groupBy("v").agg(F.count("id").alias("n")))
    until = time.time() + 3
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert out.count() == 3000

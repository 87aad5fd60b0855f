"""Session settings, the checkpoint folder and staged tables."""

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Drops a query's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("framelark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoint() at the folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster the folder must be shared, so its absence is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="framelark-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """A query that is put together and run inside leaves no shuffle files."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder, read it back.

    Lineage ends at the files, so a lost executor costs only what it ran. The
    files go when the session ends (``deleteOnExit``), or with ``unstaged``.
    Shuffle files of the write go with its end, by Spark's own setting; those of
    other jobs when the driver's garbage collector finds the shuffle
    unreachable, which it is asked to look for here.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    context = spark.sparkContext
    root = f"{context.getCheckpointDir()}/staged-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.options(compression="zstd", **options).parquet(root)
    path = context._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    gc.collect()
    context._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(root)
    out._staged = root
    return out


def unstaged(*frames: DataFrame) -> None:
    """Delete the files of those that ``staged`` returned; nothing may read them any more."""
    for df in frames:
        if "_staged" in vars(df):
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(df._staged)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path below the checkpoint folder; what lies there goes with the session."""
    ensure_checkpoint_dir(spark)
    context = spark.sparkContext
    root = f"{context.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"
    path = context._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return root

"""Line-oriented sources and sinks: labels, archives, lists, charts, items.

Text files are read in splits. A line's place in its file comes from counts
per split, so a large file is numbered without being read in one task.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelark.functions.scalars import round_exact
from framelark.operators.frames import (
    number_rows, running_total, salted_join, with_length,
)
from framelark.operators.phones import SILENCE


def file_stem(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("pos"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(utt, line_ix, line)``; utterances are named after their files."""
    rows = number_rows(_lines(spark, path), ["path"], ["pos"], F.col("split"), "line_ix")
    return rows.select("path", file_stem(F.col("path")).alias("utt"), "line_ix", "line")


# --- utterances -------------------------------------------------------------


def list_utterances(
    spark: SparkSession, folder: str, suffix: str, speakers: list[str] | None = None,
    speaker: str | None = None,
) -> DataFrame:
    """``(speaker, utt)`` of the files with a suffix below a folder.

    The speaker is the name up to the first underscore; a corpus without
    speakers gives NULL. Only the file listing is read.
    """
    if speaker is not None and speakers is not None and speaker not in speakers:
        raise KeyError(f"invalid speaker {speaker!r}")
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}")
        .option("recursiveFileLookup", "true").load(folder).select("path")
    )
    rows = files.select(file_stem(F.col("path")).alias("utt"))
    name = F.substring_index("utt", "_", 1) if speakers else F.lit(None).cast("string")
    rows = rows.select(name.alias("speaker"), "utt")
    if speakers:
        rows = rows.where(F.col("speaker").isin(speakers))
    return rows if speaker is None else rows.where(F.col("speaker") == speaker)


# --- phone labels -----------------------------------------------------------


def _phones(rows: DataFrame) -> DataFrame:
    return rows.select(
        "utt", F.col("phone_ix").cast("int").alias("phone_ix"), "t_end", "symbol"
    )


def _with_field_labels(rows: DataFrame, marks: dict[str, str]) -> DataFrame:
    """Rows ``start end symbol``, silence markers replaced."""
    fields = F.split("line", " ")
    symbol = F.get(fields, F.lit(2))
    for old, new in marks.items():
        symbol = F.when(F.get(fields, F.lit(2)) == old, new).otherwise(symbol)
    return rows.where(F.trim("line") != "").select(
        "utt", "line_ix", F.get(fields, F.lit(1)).cast("double").alias("t_end"),
        symbol.alias("symbol"),
    )


def read_mocha_labels(spark: SparkSession, path: str) -> DataFrame:
    """The two rows of the initial silent breath are dropped.

    Breath is taken as silence everywhere: its own mark is in no phone chart.
    """
    marks = {"sil": SILENCE, "breath": SILENCE}
    rows = _with_field_labels(read_lines(spark, path), marks)
    return _phones(
        rows.where(F.col("line_ix") >= 2).withColumn("phone_ix", F.col("line_ix") - 2)
    )


def read_mspka_labels(spark: SparkSession, path: str) -> DataFrame:
    rows = _with_field_labels(read_lines(spark, path), {"sil": SILENCE})
    return _phones(rows.withColumn("phone_ix", F.col("line_ix")))


def read_mngu0_labels(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated rows after a line ``#``; ends are rounded to 10 ms."""
    rows = read_lines(spark, path)
    header = rows.where(F.col("line") == "#").groupBy("path").agg(
        F.min("line_ix").alias("_header")
    )
    body = salted_join(rows, header, ["path"], "left", spread=F.col("line_ix"))
    message = F.concat(F.lit("no line # in "), F.col("path"))
    body = body.withColumn(
        "_header", F.when(F.col("_header").isNotNull(), F.col("_header")).otherwise(
            F.raise_error(message))
    )
    clean = F.replace(
        F.trim(F.col("line"), F.lit("\t")), F.lit(" 26 "), F.lit("")
    )
    fields = F.split(clean, "\t")
    body = body.where((F.col("line_ix") > F.col("_header")) & (F.trim("line") != ""))
    end = F.trim(F.get(fields, F.lit(0))).cast("double")
    return _phones(body.select(
        "utt", (F.col("line_ix") - F.col("_header") - 1).alias("phone_ix"),
        round_exact(end, 2).alias("t_end"), F.get(fields, F.lit(1)).alias("symbol"),
    ))


# --- articulators as one line per channel -----------------------------------


def read_channel_lines(spark: SparkSession, path: str) -> DataFrame:
    """Files with one blank-separated line per channel, turned into frames."""
    rows = read_lines(spark, path).where(F.trim("line") != "")
    cells = rows.select(
        "utt", F.col("line_ix").alias("channel"),
        F.posexplode(F.split(F.trim("line"), " +")).alias("frame_ix", "value"),
    )
    ordered = F.array_sort(
        F.collect_list(F.struct("channel", F.col("value").cast("double").alias("v")))
    )
    return cells.groupBy("utt", "frame_ix").agg(ordered.alias("_c")).select(
        "utt", "frame_ix", F.transform("_c", lambda c: c["v"]).alias("feats")
    )


# --- ark-like archives ------------------------------------------------------


def write_ark(frames: DataFrame, path: str) -> None:
    """``utt [``, one line of numbers per frame, `` ]`` after the last one.

    Frames are sorted over all files, so a long utterance may go on in the next
    file; the files in name order are the archive. An existing path is an error.
    """
    numbers = F.array_join(F.transform("feats", lambda x: x.cast("string")), " ")
    name = F.col("utt").cast("string")
    first = F.when(F.col("frame_ix") == 0, F.concat(name, F.lit(" [\n"))).otherwise("")
    last = F.when(F.col("frame_ix") == F.col("n") - 1, " ]").otherwise("")
    rows = with_length(frames.select("utt", "frame_ix", "feats"))
    lines = rows.repartitionByRange("utt", "frame_ix").sortWithinPartitions("utt", "frame_ix")
    lines.select(F.concat(first, numbers, last).alias("line")).write.mode(
        "errorifexists"
    ).text(path)


def read_ark(spark: SparkSession, path: str) -> DataFrame:
    """Frames of an archive; its files are read as one text, in name order."""
    place = F.struct("path", "split")
    rows = _lines(spark, path).where(F.trim("line") != "")
    opens = F.col("line").endswith("[")
    rows = running_total(rows, [], ["pos"], place, F.lit(1), "_at")
    rows = running_total(rows, [], ["pos"], place, opens.cast("int"), "_block")
    heads = rows.where(opens).select(
        "_block", F.trim(F.regexp_replace("line", r"\[$", "")).alias("utt"),
        F.col("_at").alias("_head"),
    )
    body = salted_join(rows.where(~opens), heads, ["_block"], spread=F.col("_at"))
    numbers = F.split(F.trim(F.regexp_replace("line", r"\]\s*$", "")), " +")
    return body.where(F.trim(F.regexp_replace("line", r"\]\s*$", "")) != "").select(
        "utt", (F.col("_at") - F.col("_head") - 1).cast("int").alias("frame_ix"),
        F.transform(numbers, lambda x: x.cast("double")).alias("feats"),
    )


# --- charts, filesets, items, scores ----------------------------------------

CHART_SCHEMA = (
    "common string, ipa string, common_reduced string, mngu0 string, mocha string, "
    "mspka string, type string, tongue string, openness string, voiced double"
)


def read_chart(spark: SparkSession, path: str, schema: str = CHART_SCHEMA) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_filesets(sets: DataFrame, path: str) -> None:
    """One folder of name lists per set."""
    sets.select(F.col("utt").cast("string").alias("value"), "set_name").write.mode(
        "errorifexists"
    ).partitionBy("set_name").text(path)


def read_filesets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("utt"), "set_name")


def read_fileset_lists(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """Name lists in files called after their set, such as ``trainfiles.txt``."""
    rows = spark.read.text(path).select(
        F.trim("value").alias("utt"), file_stem(F.col("_metadata.file_path")).alias("set_name")
    )
    if suffix:
        rows = rows.withColumn("set_name", F.regexp_replace("set_name", f"{suffix}$", ""))
    return rows.where(F.col("utt") != "")


def write_items(items: DataFrame, path: str) -> None:
    """Blank-separated items with a header row."""
    items.select(
        F.col("utt").alias("#file"), "onset", "offset", F.col("phone").alias("#phone"),
        "context", "speaker",
    ).write.mode("errorifexists").option("sep", " ").option("header", True).csv(path)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "`#file` string, onset double, offset double, `#phone` string, context string, "
        "speaker string"
    )
    rows = spark.read.csv(path, sep=" ", header=True, schema=schema)
    return rows.withColumnRenamed("#file", "utt").withColumnRenamed("#phone", "phone")


def read_item_archive(spark: SparkSession, path: str) -> DataFrame:
    """Items over several files, of which only the first has the header row."""
    rows = spark.read.csv(
        path, sep=" ", schema="utt string, onset double, offset double, phone string, "
        "context string, speaker string")
    return rows.where(F.col("utt") != "#file")


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("errorifexists").option("header", True).csv(path)


def read_scores(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Score tables carry their ``by`` columns, so the header names them."""
    rows = spark.read.csv(path, sep=sep, header=True)
    return rows.withColumns(
        {"score": F.col("score").cast("double"), "n": F.col("n").cast("bigint")}
    )

"""Frame, phone and vector views over the driver's tables.

Each Spark view has its SQL twin in ``CTE``, used by the oracle statements.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelark.functions.vectors import pick
from framelark.operators.frames import number_rows
from framelark.session import cut_lineage

SAMPLING_RATE = 100

# The five-symbol phone chart of the stand-in corpus.
CHART_ROWS = [
    ("#", "#", "sil", 0.0),
    ("click", "k", "C", 1.0),
    ("view", "v", "C", 0.0),
    ("purchase", "p", "P", 1.0),
    ("signup", "s", "P", 0.0),
]

CTE = {
    "fx_frames": """fx_frames AS (
  SELECT user_id AS utt, user_id % 3 AS speaker,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame_ix,
         value AS c0, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS c1,
         event_id, event_type
  FROM events)""",
    "fx_long": """fx_long AS (
  SELECT utt, speaker, frame_ix, 0 AS channel, c0 AS value FROM fx_frames
  UNION ALL SELECT utt, speaker, frame_ix, 1, c1 FROM fx_frames)""",
    "fx_phones": """fx_phones AS (
  SELECT utt, speaker, frame_ix AS phone_ix,
         CAST(0.07 AS DOUBLE) * (frame_ix + 1) + CAST(0.00013 AS DOUBLE) * (event_id % 70) AS t_end,
         CASE WHEN event_type = 'error' THEN '#' ELSE event_type END AS symbol
  FROM fx_frames)""",
    "fx_chart": """fx_chart AS (
  SELECT * FROM (VALUES ('#','#','sil',CAST(0 AS DOUBLE)), ('click','k','C',CAST(1 AS DOUBLE)),
    ('view','v','C',CAST(0 AS DOUBLE)), ('purchase','p','P',CAST(1 AS DOUBLE)),
    ('signup','s','P',CAST(0 AS DOUBLE))) AS t(symbol, common, common_reduced, voiced))""",
    "fx_vec": """fx_vec AS (
  SELECT CAST(floor(vec_id / 10) AS BIGINT) AS utt, CAST(vec_id % 10 AS INT) AS frame_ix,
         CAST(floor(vec_id / 10) AS BIGINT) % 3 AS speaker,
         CAST(embedding AS DOUBLE[]) AS feats, label
  FROM embeddings)""",
    "fx_vlong": """fx_vlong AS (
  SELECT utt, speaker, frame_ix, label, CAST(g.i AS INT) AS channel, feats[g.i + 1] AS value
  FROM fx_vec, generate_series(0, 63) AS g(i))""",
    "fx_sets": """fx_sets AS (
  SELECT DISTINCT utt, CASE utt % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS set_name
  FROM fx_frames)""",
    "fx_tri": """fx_tri AS (
  SELECT DISTINCT utt, a || '_' || b || '_' || c AS triphone FROM (
    SELECT utt, symbol AS a, lead(symbol, 1) OVER w AS b, lead(symbol, 2) OVER w AS c
    FROM fx_phones WINDOW w AS (PARTITION BY utt ORDER BY phone_ix)) t
  WHERE c IS NOT NULL)""",
}

#: Eight long tracks out of all events.
TRACKS = """WITH tracks AS (
  SELECT user_id % 8 AS utt, value AS c0, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS c1,
    CAST(row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) - 1 AS INT) AS frame_ix
  FROM events)
"""


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One utterance per user, two channels, three speakers."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("utt"),
        (F.col("user_id") % 3).alias("speaker"),
        "ts", "event_id", "event_type",
        F.array(
            F.col("value"),
            F.regexp_extract("props", "([0-9]+)", 1).cast("double"),
        ).alias("feats"),
    )
    hour = F.unix_date(F.to_date("ts")) * 24 + F.hour("ts")
    return number_rows(events, ["utt"], ["ts", "event_id"], hour).drop("ts")


def stored_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames written down once, for plans that read them several times."""
    return cut_lineage(frames(spark, sf_dir))


def phones(
    spark: SparkSession, sf_dir: str, base: DataFrame | None = None
) -> DataFrame:
    """Phone labels with strictly increasing end times; 'error' plays silence."""
    base = frames(spark, sf_dir) if base is None else base
    return base.select(
        "utt", "speaker", F.col("frame_ix").alias("phone_ix"),
        (
            F.lit(0.07) * (F.col("frame_ix") + 1)
            + F.lit(0.00013) * (F.col("event_id") % 70)
        ).alias("t_end"),
        F.when(F.col("event_type") == "error", "#")
        .otherwise(F.col("event_type")).alias("symbol"),
    )


def chart(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        CHART_ROWS, "symbol string, common string, common_reduced string, voiced double"
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty-odd utterances of ten frames, 64 channels, label as phone class."""
    utt = F.floor(F.col("vec_id") / 10)
    return table(spark, sf_dir, "embeddings").select(
        utt.alias("utt"), (utt % 3).alias("speaker"),
        (F.col("vec_id") % 10).cast("int").alias("frame_ix"),
        F.col("embedding").cast("array<double>").alias("feats"), "label",
    )


def vector_channels(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.withColumn("feats", pick(F.col("feats"), range(first, last)))


def filesets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed three-way assignment of the event utterances."""
    utts = table(spark, sf_dir, "events").select(F.col("user_id").alias("utt")).distinct()
    third = F.col("utt") % 3
    name = F.when(third == 0, "train").when(third == 1, "validation").otherwise("test")
    return utts.select("utt", name.alias("set_name"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p`` predicts ``t`` = c0 with a known error; long form, channel 0."""
    base = frames(spark, sf_dir)
    target = F.get("feats", F.lit(0))
    return base.select(
        "utt", "speaker", "frame_ix", "event_type",
        target.alias("t"), (target + 10 * F.sin(F.col("event_id").cast("double"))).alias("p"),
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight long tracks of two channels."""
    events = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).alias("utt"), "ts", "event_id",
        F.array("value", F.regexp_extract("props", "([0-9]+)", 1).cast("double")).alias("feats"))
    hour = F.unix_date(F.to_date("ts")) * 24 + F.hour("ts")
    return number_rows(events, ["utt"], ["ts", "event_id"], hour).select("utt", "frame_ix", "feats")

"""Queries: recordings and archives written from the tables and read back."""

from pyspark.sql import functions as F

from framelark.operators import phones as ph
from framelark.operators.frames import number_rows, running_total
from framelark.plans import stand_ins as si
from framelark.plans.queries_corpus import _ITEMS, _round3
from framelark.plans.registry import channels, query, r6
from framelark.plans.stand_ins import TRACKS, with_views
from framelark.session import scratch_path
from framelark.sources import archives, text
from framelark.sources.ranges import read_ranges

#: Far smaller than the default, so that the tracks of a small table are cut too.
RANGE_BYTES = 5_000

@query("est_source", TRACKS + """
SELECT utt, frame_ix, round(CAST(CAST(frame_ix / 100.0::DOUBLE AS FLOAT) AS DOUBLE), 6) + 0.0 AS time,
  round(CAST(CAST(c0 AS FLOAT) AS DOUBLE), 6) + 0.0 AS c0, round(CAST(CAST(c1 AS FLOAT) AS DOUBLE), 6) + 0.0 AS c1
FROM tracks""")
def est_source(spark, sf_dir):
    path = scratch_path(spark, "tracks")
    archives.write_tracks(si.tracks(spark, sf_dir), path, ["c0", "c1"], si.SAMPLING_RATE)
    rows = read_ranges(spark, path, "est", range_bytes=RANGE_BYTES)
    return rows.select(
        F.col("utt").cast("long").alias("utt"), "frame_ix", r6("time").alias("time"), *channels("c", 2))


@query("est_channels_pruned", TRACKS + """
SELECT utt, frame_ix, round(CAST(CAST(c1 AS FLOAT) AS DOUBLE), 6) + 0.0 AS c0 FROM tracks WHERE utt IN (2, 5)""")
def est_channels_pruned(spark, sf_dir):
    """One channel, no time: of two of the files, once filters reach the source."""
    path = scratch_path(spark, "tracks")
    archives.write_tracks(si.tracks(spark, sf_dir), path, ["c0", "c1"], si.SAMPLING_RATE)
    rows = read_ranges(
        spark, path, "est", ["utt", "frame_ix", "feats"], channels="c1", range_bytes=RANGE_BYTES)
    return rows.where(F.col("utt").isin("2", "5")).select(
        F.col("utt").cast("long").alias("utt"), "frame_ix", *channels("c", 1))


@query("npy_source", with_views("fx_vec") + """
SELECT utt, frame_ix, round(feats[64], 6) + 0.0 AS v0, round(feats[1], 6) + 0.0 AS v1,
  round(feats[31], 6) + 0.0 AS v2 FROM fx_vec""")
def npy_source(spark, sf_dir):
    path = scratch_path(spark, "arrays")
    archives.write_arrays(si.vectors(spark, sf_dir), path)
    rows = read_ranges(spark, path, "npy", channels="63,0,30", range_bytes=RANGE_BYTES)
    return rows.select(F.col("utt").cast("long").alias("utt"), "frame_ix", *channels("v", 3))


@query("wav_source", """WITH samples AS (
  SELECT user_id % 8 AS utt, (event_id * 7919) % 65536 - 32768 AS level,
    row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) - 1 AS sample_ix
  FROM events)
SELECT utt, 16000 AS sr, sample_ix, level / 32768.0::DOUBLE + 0.0 AS value FROM samples""")
def wav_source(spark, sf_dir):
    events = si.table(spark, sf_dir, "events")
    hour = F.unix_date(F.to_date("ts")) * 24 + F.hour("ts")
    samples = number_rows(
        events.select((F.col("user_id") % 8).alias("utt"), "ts", "event_id"), ["utt"], ["ts", "event_id"], hour)
    level = (F.col("event_id") * 7919) % 65536 - 32768
    path = scratch_path(spark, "recordings")
    archives.write_recordings(
        samples.select("utt", "frame_ix", (level / 32768).alias("value")), path, 16_000)
    block = 500
    rows = read_ranges(spark, path, "wav", block=block, range_bytes=RANGE_BYTES)
    return rows.select("utt", "sr", "block_ix", F.posexplode("samples").alias("at", "value")).select(
        F.col("utt").cast("long").alias("utt"), "sr",
        (F.col("block_ix") * block + F.col("at")).alias("sample_ix"), (F.col("value") + 0.0).alias("value"))


def _archive(spark, sf_dir) -> str:
    path = scratch_path(spark, "archive")
    archives.write_ark_archive(si.frames(spark, sf_dir), path)
    return path


@query("ark_text_sink", with_views("fx_frames") + """, lines AS (
  SELECT utt, -1 AS place, CAST(utt AS VARCHAR) AS opens, NULL AS first, 0 AS n_numbers, FALSE AS closes
  FROM fx_frames WHERE frame_ix = 0
  UNION ALL
  SELECT utt, frame_ix, '', c0, 2, frame_ix = max(frame_ix) OVER (PARTITION BY utt) FROM fx_frames)
SELECT row_number() OVER (ORDER BY utt, place) - 1 AS line_ix, opens, round(first, 6) + 0.0 AS first,
  n_numbers, closes FROM lines""")
def ark_text_sink(spark, sf_dir):
    """The lines of a written archive, in order."""
    rows = text._lines(spark, _archive(spark, sf_dir))
    rows = running_total(rows, [], ["pos"], F.struct("path", "split"), F.lit(1).cast("long"), "at")
    line = F.regexp_replace("line", r" \]$", "")
    opens = F.col("line").endswith("[")
    return rows.select(
        (F.col("at") - 1).alias("line_ix"),
        F.when(opens, F.regexp_replace("line", r" \[$", "")).otherwise("").alias("opens"),
        r6(F.when(~opens, F.split_part(line, F.lit(" "), F.lit(1)).cast("double"))).alias("first"),
        F.when(opens, 0).otherwise(F.size(F.split(line, " "))).alias("n_numbers"),
        F.col("line").endswith(" ]").alias("closes"))


@query("ark_text_source", with_views("fx_frames") + """
SELECT utt, frame_ix, round(c0, 6) + 0.0 AS c0, round(c1, 6) + 0.0 AS c1 FROM fx_frames""")
def ark_text_source(spark, sf_dir):
    rows = text.read_ark(spark, _archive(spark, sf_dir))
    return rows.select(F.col("utt").cast("long").alias("utt"), "frame_ix", *channels("c", 2))


@query("item_sink", with_views("fx_frames", "fx_phones") + f""", {_ITEMS}
SELECT utt, {_round3("onset")} + 0.0 AS onset, {_round3("offset_s")} + 0.0 AS "offset", phone, context, speaker
FROM fx_items""")
def item_sink(spark, sf_dir):
    path = scratch_path(spark, "items")
    phones = si.phones(spark, sf_dir, si.stored_frames(spark, sf_dir))
    archives.write_item_archive(ph.items(phones), path)
    rows = text.read_item_archive(spark, path)
    return rows.select(
        F.col("utt").cast("long").alias("utt"), (F.col("onset") + 0.0).alias("onset"),
        (F.col("offset") + 0.0).alias("offset"), "phone", "context",
        F.col("speaker").cast("long").alias("speaker"))

"""Queries: phones, transcripts, triphones, filesets, names, loading."""

from pyspark.sql import functions as F

from framelark.functions.scalars import natural_key, speaker_of, unordered_pair
from framelark.operators import filesets as fs
from framelark.operators import frames as fr
from framelark.operators import phones as ph
from framelark.plans import stand_ins as si
from framelark.plans.loading import LoadingSetup, load_dataset, load_ema
from framelark.plans.registry import channels, query, r6
from framelark.plans.stand_ins import with_views
from framelark.session import staged

SR = si.SAMPLING_RATE

_INTERVALS = """fx_iv AS (
  SELECT utt, speaker, phone_ix, symbol, t_end,
         coalesce(lag(t_end) OVER (PARTITION BY utt ORDER BY phone_ix), 0.0::DOUBLE) AS t_start,
         row_number() OVER (PARTITION BY utt ORDER BY phone_ix DESC) AS back
  FROM fx_phones)"""

_VOICING = f"""{_INTERVALS},
ends AS (SELECT utt, max(t_end) AS t_last FROM fx_phones GROUP BY utt),
grid AS (SELECT utt, unnest(generate_series(0, CAST(ceil(t_last * 100) AS BIGINT) - 1)) AS frame_ix FROM ends),
span AS (SELECT utt, voiced, CAST(round_even(t_start * 100, 0) AS BIGINT) AS a,
                CAST(round_even(t_end * 100, 0) AS BIGINT) AS b
         FROM fx_iv JOIN fx_chart USING (symbol)),
lit AS (SELECT utt, unnest(generate_series(a, b - 1)) AS frame_ix, voiced FROM span WHERE b > a),
fx_voicing AS (SELECT g.utt, CAST(g.frame_ix AS INT) AS frame_ix, coalesce(l.voiced, 0.0::DOUBLE) AS voiced
               FROM grid g LEFT JOIN lit l ON l.utt = g.utt AND l.frame_ix = g.frame_ix)"""

_BOUNDS = """fx_bounds AS (
  SELECT utt,
    CAST(floor(100 * max(CASE WHEN phone_ix = 0 THEN CASE WHEN symbol = '#' THEN t_end ELSE 0 END END)) AS INT) AS start_ix,
    CAST(ceil(100 * max(CASE WHEN back = 1 THEN CASE WHEN symbol = '#' THEN t_start ELSE t_end END END)) AS INT) AS end_ix
  FROM fx_iv GROUP BY utt)"""


@query("phone_intervals", with_views("fx_frames", "fx_phones") + f""", {_INTERVALS}
SELECT utt, phone_ix, symbol, round(t_start, 6) + 0.0 AS t_start, round(t_end, 6) + 0.0 AS t_end FROM fx_iv""")
def phone_intervals(spark, sf_dir):
    return ph.intervals(si.phones(spark, sf_dir)).select(
        "utt", "phone_ix", "symbol", r6("t_start").alias("t_start"), r6("t_end").alias("t_end")
    )


@query("voicing", with_views("fx_frames", "fx_phones", "fx_chart") + f""", {_VOICING}
SELECT utt, frame_ix, voiced FROM fx_voicing""")
def voicing(spark, sf_dir):
    return ph.voicing(si.phones(spark, sf_dir), si.chart(spark), SR)


@query("edge_silence_bounds", with_views("fx_frames", "fx_phones") + f""", {_INTERVALS}, {_BOUNDS}
SELECT utt, start_ix, end_ix FROM fx_bounds""")
def edge_silence_bounds(spark, sf_dir):
    return ph.boundaries(si.phones(spark, sf_dir), SR)


@query("trim_edges", with_views("fx_frames", "fx_phones", "fx_chart") + f""", {_VOICING}, {_BOUNDS},
ln AS (SELECT utt, min(n) AS n FROM (
  SELECT utt, count(*) AS n FROM fx_frames GROUP BY utt
  UNION ALL SELECT utt, count(*) FROM fx_voicing GROUP BY utt) k GROUP BY utt)
SELECT f.utt, CAST(f.frame_ix - b.start_ix AS INT) AS frame_ix, round(c0, 6) + 0.0 AS f0, round(c1, 6) + 0.0 AS f1,
       v.voiced
FROM fx_frames f JOIN fx_bounds b ON b.utt = f.utt JOIN ln ON ln.utt = f.utt
JOIN fx_voicing v ON v.utt = f.utt AND v.frame_ix = f.frame_ix
WHERE f.frame_ix >= b.start_ix AND f.frame_ix < least(b.end_ix, ln.n)""")
def trim_edges(spark, sf_dir):
    frames = si.stored_frames(spark, sf_dir)
    phones = si.phones(spark, sf_dir, frames)
    kinds = {"ema": frames, "voicing": ph.voicing(phones, si.chart(spark), SR)}
    bounds = ph.common_bounds(kinds, ph.boundaries(phones, SR))
    ema, flags = (ph.trim(kinds[k], bounds) for k in ("ema", "voicing"))
    return ema.join(flags, ["utt", "frame_ix"]).select(
        "utt", "frame_ix", *channels("f", 2), "voiced"
    )


@query("symbol_map", with_views("fx_frames", "fx_phones", "fx_chart") + """
SELECT utt, phone_ix, common, common_reduced FROM fx_phones JOIN fx_chart USING (symbol)""")
def symbol_map(spark, sf_dir):
    phones = si.phones(spark, sf_dir).select("utt", "phone_ix", "symbol")
    phones = phones.withColumn("source", F.col("symbol"))
    rows = ph.map_symbols(phones, si.chart(spark), "common")
    rows = rows.withColumnRenamed("symbol", "common").withColumnRenamed("source", "symbol")
    rows = ph.map_symbols(rows, si.chart(spark), "common_reduced")
    return rows.select("utt", "phone_ix", "common", F.col("symbol").alias("common_reduced"))


@query("ipa_map", with_views("fx_frames", "fx_phones") + """
SELECT symbol, CASE symbol WHEN 'click' THEN 'k' WHEN 'view' THEN 'v' END AS ipa, count(*) AS n
FROM fx_phones GROUP BY symbol""")
def ipa_map(spark, sf_dir):
    chart = si.chart(spark).where(F.col("symbol").isin("click", "view"))
    rows = si.phones(spark, sf_dir).select("symbol", F.col("symbol").alias("ipa"))
    rows = ph.map_symbols_or_null(rows, chart, "ipa", "symbol", "common")
    return rows.groupBy("symbol", "ipa").agg(F.count(F.lit(1)).alias("n"))


_ITEMS = f"""{_INTERVALS},
head AS (SELECT utt, CASE WHEN symbol = '#' THEN t_end ELSE 0 END AS zero FROM fx_phones WHERE phone_ix = 0),
fx_near AS (SELECT utt, speaker, phone_ix, symbol, t_start, t_end,
                   lag(symbol) OVER w AS prev, lead(symbol) OVER w AS nxt
            FROM fx_iv WINDOW w AS (PARTITION BY utt ORDER BY phone_ix)),
fx_items AS (SELECT n.utt, n.phone_ix, n.t_start - zero AS onset, n.t_end - zero AS offset_s, symbol AS phone,
                    prev || '_' || nxt AS context, speaker
             FROM fx_near n JOIN head USING (utt) WHERE prev IS NOT NULL AND nxt IS NOT NULL)"""


def _round3(x: str) -> str:
    """SQL for half-even rounding of the exact binary value to 3 decimals."""
    high = f"({x} * 134217729.0::DOUBLE - ({x} * 134217729.0::DOUBLE - {x}))"
    p = f"({x} * 1000.0::DOUBLE)"
    error = f"(({high} * 1000.0::DOUBLE - {p}) + ({x} - {high}) * 1000.0::DOUBLE)"
    half = f"{p} - floor({p}) = 0.5"
    return (
        f"(CASE WHEN {half} AND {error} > 0 THEN floor({p}) + 1 "
        f"WHEN {half} AND {error} < 0 THEN floor({p}) ELSE round_even({p}, 0) END / 1000.0::DOUBLE)"
    )


@query("abx_items", with_views("fx_frames", "fx_phones") + f""", {_ITEMS}
SELECT utt, phone_ix, {_round3("onset")} + 0.0 AS onset, {_round3("offset_s")} + 0.0 AS "offset", phone, context, speaker
FROM fx_items""")
def abx_items(spark, sf_dir):
    phones = si.phones(spark, sf_dir, si.stored_frames(spark, sf_dir))
    return ph.items(phones).withColumns(
        {"onset": F.col("onset") + F.lit(0.0), "offset": F.col("offset") + F.lit(0.0)}
    )


# --- transcripts ------------------------------------------------------------

_LINES = """tok AS (
  SELECT conv_id, turn, role, string_split_regex(regexp_replace(text, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g'), '[ \\t\\n\\r]+') AS tok
  FROM conversations),
ln AS (SELECT conv_id || '_' || turn AS utt, role, i - 1 AS line_ix, tok[i] AS token
       FROM (SELECT *, unnest(generate_series(1, len(tok))) AS i FROM tok) t WHERE tok[i] <> '')"""


def _label_lines(spark, sf_dir):
    """Messages as label files: every third token opens a word."""
    tokens = F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda t: t != "")
    rows = si.table(spark, sf_dir, "conversations").select(
        F.concat_ws("_", "conv_id", "turn").alias("utt"), "role",
        F.posexplode(tokens).alias("line_ix", "token"),
    )
    times = F.concat_ws(" ", F.col("line_ix"), F.col("line_ix") + 1)
    line = F.when(
        F.col("line_ix") % 3 == 0, F.concat_ws(" ", times, "role", "token")
    ).otherwise(F.concat_ws(" ", times, "token"))
    return rows.select("utt", "line_ix", line.alias("line"))


@query("transcript_words", f"""WITH {_LINES}
SELECT utt, CAST(line_ix // 3 AS INT) AS word_ix, token AS word FROM ln WHERE line_ix % 3 = 0""")
def transcript_words(spark, sf_dir):
    return ph.transcript_words(_label_lines(spark, sf_dir))


@query("transcript_phonetic", f"""WITH {_LINES},
kept AS (SELECT *, sum(CASE WHEN line_ix % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY utt ORDER BY line_ix) - 1 AS word_ix
         FROM ln WHERE token NOT IN ('the', 'la', 'die'))
SELECT utt, CAST(word_ix AS INT) AS word_ix,
       string_agg(CASE WHEN line_ix % 3 = 0 THEN role ELSE token END, '-' ORDER BY line_ix) AS word
FROM kept GROUP BY utt, word_ix""")
def transcript_phonetic(spark, sf_dir):
    return ph.phonetic_words(_label_lines(spark, sf_dir), silences=("the", "la", "die"))


@query("transcript_text", f"""WITH {_LINES}
SELECT utt, string_agg(token, ' ' ORDER BY line_ix) AS transcript FROM ln WHERE line_ix % 3 = 0 GROUP BY utt""")
def transcript_text(spark, sf_dir):
    return ph.transcript_text(ph.transcript_words(_label_lines(spark, sf_dir)))


# --- triphones and filesets -------------------------------------------------


def _doc_index(spark, sf_dir, limit=9):
    """The index of the documents, less what ``limit`` documents cannot have."""
    docs = fr.spread(si.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return ph.recurring_triphones(docs.withColumnRenamed("doc_id", "utt"), limit, joiner=" ")


_DOC = """doc_tok AS (
  SELECT doc_id AS utt, string_split_regex(regexp_replace(text, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g'), '[ \\t\\n\\r]+') AS tok FROM documents),
doc_tri AS (
  SELECT DISTINCT utt, tok[i] || ' ' || tok[i + 1] || ' ' || tok[i + 2] AS triphone
  FROM (SELECT utt, tok, unnest(generate_series(1, len(tok) - 2)) AS i FROM doc_tok WHERE len(tok) >= 3) t)"""


@query("triphones", with_views("fx_frames", "fx_phones", "fx_tri") + "SELECT utt, triphone FROM fx_tri")
def triphones(spark, sf_dir):
    return ph.triphones(si.phones(spark, sf_dir))


@query("triphone_df", f"""WITH {_DOC}
SELECT triphone, count(*) AS n FROM doc_tri GROUP BY triphone HAVING count(*) >= 9""")
def triphone_df(spark, sf_dir):
    return fs.document_frequency(_doc_index(spark, sf_dir), 9)


@query("triphone_index", f"""WITH {_DOC}
SELECT utt, triphone FROM doc_tri WHERE triphone IN (
  SELECT triphone FROM doc_tri GROUP BY triphone HAVING count(*) >= 9)""")
def triphone_index(spark, sf_dir):
    return fs.kept_index(staged(_doc_index(spark, sf_dir)), 9)


_INDEXED = with_views("fx_frames", "fx_phones", "fx_tri", "fx_sets")


def _indexed(spark, sf_dir):
    return fs.with_set(ph.triphones(si.phones(spark, sf_dir)), si.filesets(spark, sf_dir))


@query("fileset_gain", _INDEXED + """,
cov AS (SELECT DISTINCT set_name, triphone FROM fx_tri JOIN fx_sets USING (utt) WHERE utt % 7 = 0),
lack AS (SELECT t.utt, s.set_name, count(*) FILTER (WHERE c.triphone IS NULL) AS gain
         FROM fx_tri t CROSS JOIN (SELECT DISTINCT set_name FROM fx_sets) s
         LEFT JOIN cov c ON c.set_name = s.set_name AND c.triphone = t.triphone GROUP BY t.utt, s.set_name),
wide AS (SELECT utt, max(gain) FILTER (WHERE set_name = 'train') AS gain_train,
                max(gain) FILTER (WHERE set_name = 'validation') AS gain_validation,
                max(gain) FILTER (WHERE set_name = 'test') AS gain_test FROM lack GROUP BY utt)
SELECT *, CASE WHEN gain_train >= gain_validation AND gain_train >= gain_test THEN 'train'
               WHEN gain_validation >= gain_test THEN 'validation' ELSE 'test' END AS best FROM wide""")
def fileset_gain(spark, sf_dir):
    """Gain of every utterance over the coverage that every seventh one gives."""
    indexed = _indexed(spark, sf_dir)
    covered = indexed.where(F.col("utt") % 7 == 0).select("set_name", "triphone").distinct()
    return fs.best_set(fs.gains(indexed.select("utt", "triphone"), covered))


@query("fileset_coverage", _INDEXED + """
SELECT triphone, count(DISTINCT set_name) AS n_sets FROM fx_tri JOIN fx_sets USING (utt)
GROUP BY triphone HAVING count(DISTINCT set_name) <= 3""")
def fileset_coverage(spark, sf_dir):
    return fs.uncovered(_indexed(spark, sf_dir), sets=(*fs.SETS, "none"))


@query("fileset_movable", _INDEXED + """,
cnt AS (SELECT set_name, triphone, count(*) AS n FROM fx_tri JOIN fx_sets USING (utt) GROUP BY set_name, triphone)
SELECT utt, set_name, min(n) > 1 AS movable
FROM fx_tri JOIN fx_sets USING (utt) JOIN cnt USING (set_name, triphone) GROUP BY utt, set_name""")
def fileset_movable(spark, sf_dir):
    return fs.movable(_indexed(spark, sf_dir))


@query("fileset_sizes", _INDEXED + """,
tot AS (SELECT count(*) AS n FROM fx_sets)
SELECT set_name, count(*) AS n_present,
       CAST(CASE set_name WHEN 'train' THEN max(ceil(n * 0.7::DOUBLE))
            WHEN 'validation' THEN max(floor((n - ceil(n * 0.7::DOUBLE)) / 2))
            ELSE max(n - ceil(n * 0.7::DOUBLE) - floor((n - ceil(n * 0.7::DOUBLE)) / 2)) END AS BIGINT) AS n_target
FROM fx_sets, tot GROUP BY set_name""")
def fileset_sizes(spark, sf_dir):
    return fs.size_table(si.filesets(spark, sf_dir), 0.7)


@query("split_corpus")
def split_corpus(spark, sf_dir):
    """Covering split of the documents; the contract is tested, not the draw."""
    docs = si.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("utt"))
    return fs.split_corpus(staged(_doc_index(spark, sf_dir)), docs, limit=9, seed=1)


@query("split_contract", f"""WITH {_DOC},
kept AS (SELECT count(*) AS n FROM (SELECT triphone FROM doc_tri GROUP BY triphone HAVING count(*) >= 9) t),
tot AS (SELECT count(*) AS n FROM documents)
SELECT s.set_name, CAST(CASE s.set_name WHEN 'train' THEN ceil(tot.n * 0.7::DOUBLE)
         WHEN 'validation' THEN floor((tot.n - ceil(tot.n * 0.7::DOUBLE)) / 2)
         ELSE tot.n - ceil(tot.n * 0.7::DOUBLE) - floor((tot.n - ceil(tot.n * 0.7::DOUBLE)) / 2) END AS BIGINT) AS n_utts,
       kept.n AS n_triphones
FROM (VALUES ('train'), ('validation'), ('test')) AS s(set_name), tot, kept""")
def split_contract(spark, sf_dir):
    """What every covering split must show: set sizes, and all kept triphones in each."""
    docs = si.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("utt"))
    index = staged(_doc_index(spark, sf_dir))
    sets = fs.split_corpus(index, docs, limit=9, seed=1)
    kept = staged(fs.kept_index(index, 9)).join(sets, "utt").select("set_name", "triphone").distinct()
    covered = kept.groupBy("set_name").agg(F.count(F.lit(1)).alias("n_triphones"))
    sizes = sets.groupBy("set_name").agg(F.count(F.lit(1)).alias("n_utts"))
    return sizes.join(covered, "set_name")


@query("fileset_semi_join", """
SELECT doc_id AS utt, lang, n_chars FROM documents
WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def fileset_semi_join(spark, sf_dir):
    docs = si.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("utt"), "lang", "n_chars"
    )
    name = F.when(F.col("quality") == 1, "train").otherwise("test")
    sets = si.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("utt"), name.alias("set_name")
    )
    return fs.in_fileset(docs, sets, "train")


@query("adjust_filesets_names", """
WITH u AS (SELECT chr(CAST(97 + doc_id % 8 AS INT)) || 'u' || doc_id || chr(CAST(97 + doc_id % 9 AS INT)) AS utt,
                  'u' || doc_id AS name FROM documents),
p AS (SELECT 'u' || doc_id AS name, CASE WHEN quality = 1 THEN 'train' ELSE 'test' END AS set_name FROM labels)
SELECT u.utt, p.set_name || '_initial' AS set_name
FROM u JOIN p ON p.name = regexp_replace(u.utt, '^[a-f]+|[a-f]+$', '', 'g')""")
def adjust_filesets_names(spark, sf_dir):
    """Document names with part letters at both ends against the labelled ones."""
    name = F.concat(F.lit("u"), F.col("doc_id"))
    utts = si.table(spark, sf_dir, "documents").select(
        F.concat(
            F.char((97 + F.col("doc_id") % 8).cast("int")), name,
            F.char((97 + F.col("doc_id") % 9).cast("int")),
        ).alias("utt")
    )
    provided = si.table(spark, sf_dir, "labels").select(
        name.alias("utt"),
        F.when(F.col("quality") == 1, "train").otherwise("test").alias("set_name"),
    )
    return fs.adjust_provided(utts, provided)


@query("same_speaker_rank", """
WITH r AS (SELECT c_nationkey AS speaker, c_name AS utt,
                  CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) - 1 AS INT) AS rank FROM customer)
SELECT speaker, utt, rank, CASE rank % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS set_name FROM r""")
def same_speaker_rank(spark, sf_dir):
    utts = si.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("speaker"), F.col("c_name").alias("utt")
    )
    ranks = fs.same_speaker_rank(utts)
    third = F.col("rank") % 3
    name = F.when(third == 0, "train").when(third == 1, "validation").otherwise("test")
    sets = ranks.select("rank").distinct().withColumn("set_name", name)
    return fs.generalize_to_speakers(sets, ranks).select("speaker", "utt", "rank", "set_name")


@query("natural_sort", """
WITH k AS (SELECT c_mktsegment || (c_custkey * 7 % 1000) || 'x' || c_custkey AS name, c_mktsegment AS a,
                  c_custkey * 7 % 1000 AS b, c_custkey AS c FROM customer)
SELECT name, row_number() OVER (ORDER BY a, b, c) - 1 AS place FROM k""")
def natural_sort(spark, sf_dir):
    """Natural order of names like BUILDING70x10, shown as places."""
    custkey = F.col("c_custkey")
    rows = si.table(spark, sf_dir, "customer").select(
        F.concat(F.col("c_mktsegment"), custkey * 7 % 1000, F.lit("x"), custkey).alias("name")
    )
    rows = rows.withColumn("_key", F.array_join(natural_key(F.col("name")), "\x01"))
    return fr.number_rows(rows, [], ["_key", "name"], None, "place").select(
        "name", F.col("place").cast("bigint").alias("place")
    )


@query("utterance_list", """
SELECT split_part(c_mktsegment || '_' || c_name, '_', 1) AS speaker, c_mktsegment || '_' || c_name AS utt FROM customer""")
def utterance_list(spark, sf_dir):
    """Speakers as the name part before the first underscore."""
    utt = F.concat_ws("_", "c_mktsegment", "c_name")
    return si.table(spark, sf_dir, "customer").select(speaker_of(utt).alias("speaker"), utt.alias("utt"))


@query("phone_pairs", with_views("fx_frames", "fx_phones") + """
SELECT least(symbol, nxt) || '_' || greatest(symbol, nxt) AS pair, count(*) AS n FROM (
  SELECT symbol, lead(symbol) OVER (PARTITION BY utt ORDER BY phone_ix) AS nxt FROM fx_phones) t
WHERE nxt IS NOT NULL GROUP BY 1""")
def phone_pairs(spark, sf_dir):
    rows = ph.neighbours(
        si.phones(spark, sf_dir),
        {"_next": F.lead("symbol", 1).over(fr.segment_window(ix="phone_ix"))}, 1,
    ).where(F.col("_next").isNotNull())
    return rows.groupBy(unordered_pair(F.col("symbol"), F.col("_next")).alias("pair")).agg(
        F.count(F.lit(1)).alias("n")
    )


# --- loading ----------------------------------------------------------------

_EMA = """,
ema AS (SELECT utt, speaker, frame_ix, c1 AS x, count(*) OVER (PARTITION BY utt) AS n,
               c1 - avg(c1) OVER (PARTITION BY speaker) AS s FROM fx_frames)"""


def _d(expr):
    from framelark.plans.queries_frames import _sql_delta
    return _sql_delta(expr)


_W = """WINDOW w AS (PARTITION BY utt ORDER BY frame_ix),
  wf AS (PARTITION BY utt ORDER BY frame_ix ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
_LOADED = f""", {_VOICING}{_EMA},
e1 AS (SELECT utt, frame_ix, n, s, {_d('s')} AS d FROM ema {_W}),
e2 AS (SELECT utt, frame_ix, s, d, {_d('d')} AS dd FROM e1 {_W}),
loaded AS (SELECT e2.utt, e2.frame_ix, s, v.voiced, d, dd FROM e2
           JOIN fx_voicing v ON v.utt = e2.utt AND v.frame_ix = e2.frame_ix)"""


@query("load_ema", with_views("fx_frames", "fx_phones", "fx_chart") + _LOADED + """
SELECT utt, frame_ix, round(s, 6) + 0.0 AS f0, voiced AS f1, round(d, 6) + 0.0 AS f2, round(dd, 6) + 0.0 AS f3
FROM loaded""")
def load_ema_query(spark, sf_dir):
    """One chosen articulator, de-meaned per speaker, with dynamics and voicing."""
    frames = si.stored_frames(spark, sf_dir)
    rows = load_ema(
        frames, ["c0", "c1"],
        LoadingSetup(articulators=["c1", "voicing"], ema_norm="mean_byspeaker"),
        voicing=ph.voicing(si.phones(spark, sf_dir, frames), si.chart(spark), SR),
    )
    return rows.select("utt", "frame_ix", *channels("f", 4))


@query("load_dataset", with_views("fx_frames", "fx_phones", "fx_chart", "fx_sets") + _LOADED + """,
ac AS (SELECT utt, frame_ix, (c0 - avg(c0) OVER p) / nullif(stddev_pop(c0) OVER p, 0) AS a,
              (c1 - avg(c1) OVER p) / nullif(stddev_pop(c1) OVER p, 0) AS b
       FROM fx_frames WINDOW p AS (PARTITION BY speaker))
SELECT l.utt, l.frame_ix, round(coalesce(pa, 0), 6) + 0.0 AS x0, round(coalesce(pb, 0), 6) + 0.0 AS x1,
       round(a, 6) + 0.0 AS x2, round(b, 6) + 0.0 AS x3,
       round(coalesce(na, 0), 6) + 0.0 AS x4, round(coalesce(nb, 0), 6) + 0.0 AS x5,
       round(s, 6) + 0.0 AS y0, voiced AS y1, round(d, 6) + 0.0 AS y2, round(dd, 6) + 0.0 AS y3
FROM loaded l
JOIN (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb, lead(a) OVER w AS na, lead(b) OVER w AS nb FROM ac
      WINDOW w AS (PARTITION BY utt ORDER BY frame_ix)) c ON c.utt = l.utt AND c.frame_ix = l.frame_ix
JOIN fx_sets fs ON fs.utt = l.utt WHERE fs.set_name = 'train'""")
def load_dataset_query(spark, sf_dir):
    """Inputs in context and dynamic targets of the training set, paired by frame."""
    frames = si.stored_frames(spark, sf_dir)
    setup = LoadingSetup(
        audio_type="mfcc_stds_byspeaker", articulators=["c1", "voicing"],
        context_window=1, ema_norm="mean_byspeaker",
    )
    rows = load_dataset(
        {"mfcc": frames, "ema": frames}, {"mfcc": 2, "ema": 2}, ["c0", "c1"], setup,
        voicing=ph.voicing(si.phones(spark, sf_dir, frames), si.chart(spark), SR),
        filesets=si.filesets(spark, sf_dir), set_name="train",
    )
    return rows.select(
        "utt", "frame_ix", *channels("x", 6, source="acoustic"),
        *channels("y", 4, source="ema"),
    )

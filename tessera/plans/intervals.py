"""Queries of interval operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import intervals as iv
from tessera.operators.scan import SLICE, spread
from tessera.sources.tables import event_words, table

#: event gaps are hours, so thresholds are too
PAUSE, MERGE, KEEP = 36000.0, 60.0, 30.0
WORDS = """words AS (
  SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id AS word_id, event_type AS text,
    (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS start_sec,
    (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 + least(value, 30.0) AS end_sec,
    CASE WHEN event_id % 10 <> 0 THEN ((event_id * 37) % 100) / 100.0 END AS confidence
  FROM events
), durations AS (SELECT key, max(end_sec) + 5000.0 AS duration_sec FROM words GROUP BY key),
silences AS (SELECT key, start_sec - 900.0 AS start_sec, end_sec + 900.0 AS end_sec FROM words WHERE text = 'error')"""
MERGED = """{out} AS (
  SELECT key, min(start_sec) AS start_sec, max(end_sec) AS end_sec FROM (
    SELECT *, sum(n) OVER (PARTITION BY key ORDER BY start_sec, end_sec ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN start_sec <= max(end_sec) OVER (PARTITION BY key ORDER BY start_sec, end_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS n
      FROM {src} WHERE end_sec > start_sec AND end_sec - start_sec >= {least})) GROUP BY key, island
)"""
KEPT = """inside AS (
  SELECT key, duration_sec, greatest(0.0, least(start_sec, duration_sec)) AS start_sec, greatest(0.0, least(end_sec, duration_sec)) AS end_sec
  FROM {src} JOIN {dur} USING (key)
), parts AS (
  SELECT key, coalesce(max(end_sec) OVER (PARTITION BY key ORDER BY start_sec, end_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS a, start_sec AS b
  FROM inside WHERE end_sec > start_sec
  UNION ALL SELECT key, coalesce(max(end_sec), 0.0), any_value(duration_sec)
  FROM (SELECT d.key, d.duration_sec, i.end_sec FROM {dur} d LEFT JOIN (SELECT * FROM inside WHERE end_sec > start_sec) i ON d.key = i.key) GROUP BY key
), part_list AS (SELECT key, round(a, 3) AS start_sec, round(b, 3) AS end_sec FROM parts WHERE b > a + {over} AND round(b, 3) > round(a, 3) + {least}),
{out} AS (SELECT * FROM part_list {rest})"""
WHOLE = "UNION ALL SELECT key, 0.0, round(duration_sec, 3) FROM {dur} d WHERE duration_sec > 0 AND NOT EXISTS (SELECT 1 FROM part_list s WHERE s.key = d.key)"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_words(table(spark, sf_dir, "events"))


def durations(w: DataFrame) -> DataFrame:
    return w.groupBy("key").agg((F.max("end_sec") + 5000.0).alias("duration_sec"))


def silences(w: DataFrame) -> DataFrame:
    return w.filter("text = 'error'").select("key", (F.col("start_sec") - 900.0).alias("start_sec"), (F.col("end_sec") + 900.0).alias("end_sec"), *[c for c in w.columns if c == SLICE])


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.round(c, 3).alias(c) for c in df.columns if c not in (*keys, SLICE)])


def w5_pauses(spark, sf_dir):
    return rounded(iv.pauses(words(spark, sf_dir), PAUSE), "key")


W5 = f"WITH {WORDS} SELECT key, round(end_sec, 3) AS start_sec, round(nx, 3) AS end_sec FROM (SELECT *, lead(start_sec) OVER (PARTITION BY key ORDER BY seq) AS nx FROM words) WHERE nx - end_sec >= {PAUSE}"


def w6_merged_silences(spark, sf_dir):
    return rounded(iv.merged(silences(words(spark, sf_dir)), MERGE, 100.0), "key")


W6 = f"WITH {WORDS}, {MERGED.format(out='m', src='silences', gap=MERGE, least=100.0)} SELECT key, round(start_sec, 3) AS start_sec, round(end_sec, 3) AS end_sec FROM m"


def w7_keep_ranges(spark, sf_dir):
    w = words(spark, sf_dir)
    return iv.complement(iv.merged(silences(w), MERGE), durations(w), KEEP)


W7 = f"WITH {WORDS}, {MERGED.format(out='m', src='silences', gap=MERGE, least=0.0)}, {KEPT.format(src='m', dur='durations', over=KEEP, least=0.0, rest=WHOLE.format(dur='durations'), out='k')} SELECT * FROM k"


def _kept(w: DataFrame) -> DataFrame:
    return w.filter("(word_id * 7 + key) % 3 <> 0 and key % 11 <> 0").select("key", "word_id")


def w8_deleted_runs(spark, sf_dir):
    w = words(spark, sf_dir)
    return rounded(iv.deleted_runs(w, _kept(w), durations(w), 3.0, 1000.0), "key")


RUNS = """marked AS (
  SELECT *, (word_id * 7 + key) % 3 <> 0 AND key % 11 <> 0 AS kept FROM words JOIN durations USING (key)
), placed AS (
  SELECT *, sum(kept::INT) OVER (PARTITION BY key ORDER BY start_sec, end_sec, seq ROWS UNBOUNDED PRECEDING) AS run,
    last_value(CASE WHEN kept THEN end_sec END IGNORE NULLS) OVER (PARTITION BY key ORDER BY start_sec, end_sec, seq ROWS UNBOUNDED PRECEDING) AS before,
    first_value(CASE WHEN kept THEN start_sec END IGNORE NULLS) OVER (PARTITION BY key ORDER BY start_sec, end_sec, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after,
    max(end_sec) OVER (PARTITION BY key) AS fin
  FROM marked
), run_ends AS (
  SELECT key, run, any_value(before) AS before, any_value(after) AS after, any_value(duration_sec) AS dur, any_value(fin) AS fin, max(end_sec) AS e FROM placed WHERE NOT kept GROUP BY key, run
), cuts AS (
  SELECT * FROM (SELECT key, greatest(0.0, least(dur, CASE WHEN before IS NULL THEN 0.0 ELSE before + 3.0 END)) AS start_sec,
    greatest(0.0, least(dur, CASE WHEN after IS NULL AND e = fin AND dur - fin > 1000.0 THEN fin WHEN after IS NULL THEN dur ELSE after - 3.0 END)) AS end_sec FROM run_ends) WHERE end_sec > start_sec
)"""
W8 = f"WITH {WORDS}, {RUNS} SELECT key, round(start_sec, 3) AS start_sec, round(end_sec, 3) AS end_sec FROM cuts"


def w9_w10_text_cut(spark, sf_dir):
    w = words(spark, sf_dir)
    return iv.text_cut(w, _kept(w), durations(w), 3.0, 3600.0, 7200.0, 1000.0)


W9 = f"""WITH {WORDS}, {RUNS}, {MERGED.format(out='m', src='cuts', gap=3600.0, least=0.0)}, long AS (SELECT * FROM m WHERE end_sec - start_sec >= 7200.0),
alive AS (SELECT key, duration_sec FROM durations WHERE key % 11 <> 0 AND key IN (SELECT key FROM marked WHERE kept)),
{KEPT.format(src='long', dur='alive', over=0.0, least=0.02, rest='', out='k')} SELECT * FROM k"""


def w1_largest_gap(spark, sf_dir):
    w = words(spark, sf_dir)
    return rounded(iv.largest_gap(w, durations(w)), "key")


GAPS = """all_gaps AS (
  SELECT key, coalesce(lag(end_sec) OVER (PARTITION BY key ORDER BY start_sec, end_sec), 0.0) AS a, start_sec AS b FROM words
  UNION ALL SELECT key, arg_max(end_sec, row(start_sec, end_sec)), any_value(duration_sec) FROM words JOIN durations USING (key) GROUP BY key
)"""
W1 = f"WITH {WORDS}, {GAPS} SELECT key, round(greatest(0.0, max(b - a)), 3) AS max_gap FROM all_gaps GROUP BY key"


def w2_long_gaps(spark, sf_dir):
    w = words(spark, sf_dir)
    return rounded(iv.gaps(w, durations(w), 50000.0), "key")


W2 = f"WITH {WORDS}, {GAPS} SELECT key, round(a, 3) AS start_sec, round(b, 3) AS end_sec FROM all_gaps WHERE b - a >= 50000.0 AND b > a"


def w3_suspicious_gap(spark, sf_dir):
    w = words(spark, sf_dir)
    return iv.suspicious_gaps(w, durations(w), 150000.0, 65)


W3 = f"WITH {WORDS}, {GAPS} SELECT d.key, (SELECT count(*) FROM words w WHERE w.key = d.key) >= 65 AND duration_sec >= 225000.0 AND (SELECT max(b - a) FROM all_gaps g WHERE g.key = d.key) >= 150000.0 AS suspicious FROM durations d"


def w4_sparse_windows(spark, sf_dir):
    w = words(spark, sf_dir)
    return rounded(iv.sparse_windows(w, durations(w), 200000.0, 100000.0, 3), "key", "n")


W4 = f"""WITH {WORDS}, spine AS (
  SELECT key, first + k * 100000.0 AS window_start FROM (
    SELECT key, first, unnest(range(0, CAST(floor((duration_sec + 1e-6 - 200000.0 - first) / 100000.0) AS BIGINT) + 1)) AS k
    FROM (SELECT key, duration_sec, greatest(0.0, least(200000.0, duration_sec - 200000.0)) AS first FROM durations))
)
SELECT s.key, round(window_start, 3) AS window_start, count(w.key) AS n
FROM spine s LEFT JOIN words w ON w.key = s.key AND w.start_sec >= window_start AND w.start_sec < window_start + 200000.0 GROUP BY s.key, window_start HAVING count(w.key) < 3"""


def w20_trim(spark, sf_dir):
    w = words(spark, sf_dir)
    return iv.trimmed(w.filter("seq > 1"), silences(w), durations(w), 4000.0, 600.0, 100.0)


W20 = f"""WITH {WORDS}, s AS (SELECT key, min(row(start_sec, end_sec)) AS s0, max(row(start_sec, end_sec)) AS s1 FROM silences GROUP BY key),
w AS (SELECT key, min(start_sec) AS w0, max(end_sec) AS w1 FROM words WHERE seq > 1 GROUP BY key), e AS (
  SELECT d.key, duration_sec AS dur, greatest(0.0, CASE WHEN s0[1] <= 4000.0 THEN s0[2] ELSE 0.0 END, w0 - 600.0) AS a,
    least(duration_sec, CASE WHEN s1[2] >= duration_sec - 4000.0 THEN s1[1] ELSE duration_sec END, w1 + 600.0) AS b
  FROM durations d LEFT JOIN s ON s.key = d.key LEFT JOIN w ON w.key = d.key
)
SELECT key, round(CASE WHEN b > a + 100.0 THEN a ELSE 0.0 END, 3) AS start_sec, round(CASE WHEN b > a + 100.0 THEN b ELSE dur END, 3) AS end_sec FROM e"""


def j4_overlap_join(spark, sf_dir):
    w = words(spark, sf_dir)
    clips = durations(w).select("key", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("clip"), "duration_sec")
    clips = clips.select("key", "clip", (F.col("clip") * F.col("duration_sec") / 10).alias("start_sec"), ((F.col("clip") + 0.5) * F.col("duration_sec") / 10).alias("end_sec"))
    return rounded(iv.overlaps(silences(w).drop(SLICE).withColumn("what", F.lit("silence")), clips, 50000.0), "key", "what", "clip")


J4 = f"""WITH {WORDS}, clips AS (SELECT key, clip, clip * duration_sec / 10 AS s, (clip + 0.5) * duration_sec / 10 AS e FROM durations, (SELECT unnest(range(0, 10))::INT AS clip))
SELECT c.key, 'silence' AS what, clip, round(greatest(s, start_sec), 3) AS start_sec, round(least(e, end_sec), 3) AS end_sec FROM silences x JOIN clips c ON x.key = c.key AND start_sec < e AND end_sec > s"""


def j7_words_in_gaps(spark, sf_dir):
    w = words(spark, sf_dir)
    return iv.inside_gaps(w, iv.gaps(w.filter("text <> 'view'"), durations(w), 50000.0), 20.0).select("key", "word_id")


J7 = f"""WITH {WORDS}, all_gaps AS (
  SELECT key, coalesce(lag(end_sec) OVER (PARTITION BY key ORDER BY start_sec, end_sec), 0.0) AS a, start_sec AS b FROM words WHERE text <> 'view'
  UNION ALL SELECT d.key, coalesce(l, 0.0), duration_sec FROM durations d LEFT JOIN (SELECT key, arg_max(end_sec, row(start_sec, end_sec)) AS l FROM words WHERE text <> 'view' GROUP BY key) x ON x.key = d.key
)
SELECT key, word_id FROM words w WHERE EXISTS (SELECT 1 FROM all_gaps g WHERE g.key = w.key AND b - a >= 50000.0 AND b > a AND (start_sec + end_sec) / 2 BETWEEN a - 20.0 AND b + 20.0)"""


def _times(w: DataFrame) -> DataFrame:
    return durations(w).select("key", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("k"), "duration_sec").select("key", (F.col("k") * F.col("duration_sec") / 40).alias("t")).union(w.filter("seq % 7 = 0").select("key", F.col("start_sec") + 0.5)).distinct()


TIMES = "times AS (SELECT key, k * duration_sec / 40 AS t FROM durations, (SELECT unnest(range(0, 41))::INT AS k) UNION SELECT key, start_sec + 0.5 FROM words WHERE seq % 7 = 0)"


def j8_active_word(spark, sf_dir):
    w = words(spark, sf_dir).withColumn("deleted", F.col("text") == "error")
    return iv.active_words(_times(w), w).select("key", F.round("t", 3).alias("t"), "word_id")


J8 = f"""WITH {WORDS}, {TIMES}, kept AS (SELECT * FROM words WHERE text <> 'error')
SELECT key, round(t, 3) AS t, coalesce(
  (SELECT arg_min(word_id, seq) FROM kept k WHERE k.key = x.key AND start_sec <= t AND end_sec >= t),
  (SELECT arg_min(word_id, row(start_sec, seq)) FROM kept k WHERE k.key = x.key AND start_sec >= t),
  (SELECT arg_max(word_id, row(end_sec, seq)) FROM kept k WHERE k.key = x.key AND end_sec <= t)) AS word_id FROM times x"""


def laid_out(w: DataFrame) -> DataFrame:
    """Clips of every third word's surroundings, one after the other, at changing speeds."""
    from tessera.operators.timeline import rippled

    c = w.filter("seq % 3 = 0").select("key", "seq", F.col("seq").alias("clip_ord"), "start_sec", (F.col("start_sec") + 600.0 + F.col("seq")).alias("end_sec"), F.lit(0.0).alias("timeline_start_sec"), (F.lit(1.0) + F.col("seq") % 2).alias("speed"))
    return rippled(c, "key", ["seq"])


CLIPS = """clips AS (
  SELECT key, seq, start_sec, start_sec + 600.0 + seq AS end_sec, 1.0 + seq % 2 AS speed,
    round(coalesce(sum((600.0 + seq) / (1.0 + seq % 2)) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 3) AS tl
  FROM words WHERE seq % 3 = 0
)"""


def j9_to_source_time(spark, sf_dir):
    w = words(spark, sf_dir)
    clips = laid_out(w)
    times = clips.select("key", (F.col("timeline_start_sec") + 100.25).alias("t")).union(clips.groupBy("key").agg(F.max("timeline_start_sec") + 10000.0))
    return iv.to_source_time(times, clips).select("key", F.round("t", 3).alias("t"), "source_sec")


J9 = f"""WITH {WORDS}, {CLIPS}, times AS (SELECT key, tl + 100.25 AS t FROM clips UNION ALL SELECT key, max(tl) + 10000.0 FROM clips GROUP BY key),
hit AS (SELECT x.key, t, (SELECT arg_min(CASE WHEN t < tl THEN start_sec ELSE start_sec + (t - tl) * speed END, tl) FROM clips c WHERE c.key = x.key AND t <= tl + (end_sec - start_sec) / speed) AS s FROM times x)
SELECT key, round(t, 3) AS t, round(coalesce(s, (SELECT arg_max(end_sec, tl) FROM clips c WHERE c.key = hit.key)), 3) AS source_sec FROM hit"""


def j10_to_edited_time(spark, sf_dir):
    w = words(spark, sf_dir)
    return iv.to_edited_time(w.filter("seq % 4 <> 1").select("key", (F.col("start_sec") + 300.125).alias("t")), laid_out(w)).select("key", F.round("t", 3).alias("t"), "edited_sec")


J10 = f"""WITH {WORDS}, {CLIPS}, times AS (SELECT key, start_sec + 300.125 AS t FROM words WHERE seq % 4 <> 1),
edges AS (SELECT key, tl, 0 AS e, start_sec AS pos, tl AS dst FROM clips UNION ALL SELECT key, tl, 1, end_sec, tl + (end_sec - start_sec) / speed FROM clips)
SELECT key, round(t, 3) AS t, round(coalesce(
  (SELECT arg_min(tl + (t - start_sec) / speed, tl) FROM clips c WHERE c.key = x.key AND t BETWEEN start_sec AND end_sec),
  (SELECT arg_min(dst, row(abs(t - pos), tl, e)) FROM edges g WHERE g.key = x.key)), 3) AS edited_sec FROM times x"""


def auto_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: pauses, fillers and silences become cuts, the rest is laid out anew."""
    from tessera.operators.timeline import relaid

    w = words(spark, sf_dir)
    fillers = w.filter(F.col("text").isin("click", "signup")).select("key", "start_sec", "end_sec")
    cuts = iv.pauses(w, PAUSE).unionByName(fillers).unionByName(silences(w).drop(SLICE)).distinct()
    return relaid(iv.complement(iv.merged(spread(cuts, *iv.TIME), MERGE), durations(w), KEEP), ["key"]).drop(SLICE)


AUTO = f"""WITH {WORDS}, c AS (
  SELECT key, end_sec AS start_sec, nx AS end_sec FROM (SELECT *, lead(start_sec) OVER (PARTITION BY key ORDER BY seq) AS nx FROM words) WHERE nx - end_sec >= {PAUSE}
  UNION SELECT key, start_sec, end_sec FROM words WHERE text IN ('click', 'signup') UNION SELECT key, start_sec, end_sec FROM silences
), {MERGED.format(out='m', src='c', gap=MERGE, least=0.0)}, {KEPT.format(src='m', dur='durations', over=KEEP, least=0.0, rest=WHOLE.format(dur='durations'), out='k')}
SELECT key, start_sec, end_sec, round(coalesce(sum(end_sec - start_sec) OVER (PARTITION BY key ORDER BY start_sec, end_sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 3) AS timeline_start_sec FROM k"""

QUERIES = {
    "e12_auto_cut": (auto_cut, AUTO),
    "w1_largest_gap": (w1_largest_gap, W1),
    "w2_long_gaps": (w2_long_gaps, W2),
    "w3_suspicious_gap": (w3_suspicious_gap, W3),
    "w4_sparse_windows": (w4_sparse_windows, W4),
    "w5_pauses": (w5_pauses, W5),
    "w6_merged_silences": (w6_merged_silences, W6),
    "w7_keep_ranges": (w7_keep_ranges, W7),
    "w8_deleted_runs": (w8_deleted_runs, W8),
    "w9_w10_text_cut": (w9_w10_text_cut, W9),
    "w20_trim": (w20_trim, W20),
    "j4_j5_overlap_join": (j4_overlap_join, J4),
    "j7_words_in_gaps": (j7_words_in_gaps, J7),
    "j8_active_word": (j8_active_word, J8),
    "j9_to_source_time": (j9_to_source_time, J9),
    "j10_to_edited_time": (j10_to_edited_time, J10),
}

"""Queries that cut words into chunks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import segments as sg
from tessera.operators.scan import SLICE
from tessera.plans.intervals import WORDS, rounded
from tessera.plans.intervals import words as timed
from tessera.sources.tables import conversation_words, mock_words, table, unnumbered_words

TALK = r"""turns AS (
  SELECT conv_id AS key, turn AS segment, turn * 10.0::DOUBLE AS s, string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' ') AS parts FROM conversations
), spread AS (
  SELECT key, segment, s, greatest(len(parts) * 0.33::DOUBLE, 0.1) / len(parts) AS step, unnest(parts) AS text, unnest(range(0, len(parts))) AS i FROM turns
), talk AS (
  SELECT key, row_number() OVER (PARTITION BY key ORDER BY segment, i) AS seq, text, s + i * step AS start_sec, s + (i + 1) * step AS end_sec FROM spread WHERE text <> ''
)"""
SPLIT = """{out} AS (
  SELECT key, row_number() OVER (PARTITION BY key ORDER BY min(seq)) AS chunk, min(seq) AS first_seq, count(*) AS n, string_agg(text, ' ' ORDER BY seq) AS text, arg_min(start_sec, seq) AS start_sec, arg_max(end_sec, seq) AS end_sec
  FROM (SELECT *, (row_number() OVER (PARTITION BY key, part ORDER BY seq) - 1) // {size} AS sub FROM (
    SELECT *, sum(n) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS part FROM (
      SELECT *, CASE WHEN start_sec - lag(end_sec) OVER (PARTITION BY key ORDER BY seq) > {gap} OR {ends} THEN 1 WHEN lag(end_sec) OVER (PARTITION BY key ORDER BY seq) IS NULL THEN 1 ELSE 0 END AS n FROM {src})))
  GROUP BY key, part, sub HAVING count(*) >= {least}
)"""
AFTER = "regexp_matches(lag(trim(text)) OVER (PARTITION BY key ORDER BY seq), '[.!?]$')"
OUT = "key, chunk, n, text, round(start_sec, 3) AS start_sec, round(end_sec, 3) AS end_sec"


def talk(spark, sf_dir):
    return conversation_words(table(spark, sf_dir, "conversations"))


def s13_spread_words(spark, sf_dir):
    return rounded(talk(spark, sf_dir), "key", "seq", "text")


def s12_mock_words(spark, sf_dir):
    return rounded(mock_words(table(spark, sf_dir, "part"), "p_partkey", "p_size"), "key", "seq", "text")


S12 = """WITH d AS (SELECT p_partkey AS key, greatest(p_size::DOUBLE, 3.0) AS dur FROM part),
n AS (SELECT key, dur, greatest(8, CAST(round_even(dur * 2.2, 0) AS INT)) AS n FROM d), w AS (SELECT key, dur, dur / n AS step, unnest(range(0, n))::INT AS i FROM n)
SELECT key, i + 1 AS seq, ['this', 'is', 'a', 'generated', 'transcript', 'preview', 'edit', 'the', 'text', 'to', 'cut', 'the', 'video', 'automatically'][i % 14 + 1] AS text,
  round(i * step, 3) AS start_sec, round(least(dur, i * step + greatest(0.08, step * 0.82)), 3) AS end_sec FROM w"""


def _out(df):
    return df.select("key", "chunk", "n", "text", F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"))


def w11_slot_chunks(spark, sf_dir):
    return _out(sg.slot_chunks(talk(spark, sf_dir), 4, 12))


def w12_sentences(spark, sf_dir):
    return _out(sg.sentences(talk(spark, sf_dir)))


def w13_paragraphs(spark, sf_dir):
    return _out(sg.paragraphs(sg.sentences(talk(spark, sf_dir))))


SENT = SPLIT.format(out="sent", src="talk", gap=1.1, size=12, ends=AFTER, least=1)


def w14_captions(spark, sf_dir):
    """Captions of conversations; words along the turns have the order of their numbers, which needn't be computed."""
    return sg.captions(unnumbered_words(table(spark, sf_dir, "conversations")), order=("start_sec", "segment", "i"))


W14 = rf"""WITH RECURSIVE {TALK}, o AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY start_sec, seq) AS k, trim(text) AS text, start_sec, end_sec FROM talk),
f AS (
  SELECT key, k, 1 AS cap, 1 AS n, text AS acc, start_sec AS a, end_sec AS b FROM o WHERE k = 1
  UNION ALL SELECT key, k, CASE WHEN cut THEN cap + 1 ELSE cap END, CASE WHEN cut THEN 1 ELSE n + 1 END, CASE WHEN cut THEN text ELSE acc || ' ' || text END, CASE WHEN cut THEN s ELSE a END, e
  FROM (SELECT f.key, o.k, cap, n, acc, a, o.text, o.start_sec AS s, o.end_sec AS e,
      o.start_sec - b > 0.55 OR n >= 3 OR length(acc) + 1 + length(o.text) > 42 OR (n >= 2 AND regexp_matches(acc, '[.!?]$')) OR (n >= 2 AND regexp_matches(acc, '[,;:—–]$')) AS cut
    FROM f JOIN o ON o.key = f.key AND o.k = f.k + 1)
)
SELECT key, cap AS caption, arg_max(acc, k) AS text, round(min(a), 3) AS start_sec, greatest(round(greatest(arg_max(b, k), min(a) + 0.12) - min(a), 3), 0.12) AS duration_sec FROM f GROUP BY key, cap"""


def _loopy(spark, sf_dir):
    """Event types as words, with stretches of letters that repeat two, three or four words, by transcript."""
    seq, key = F.col("seq"), F.col("key")
    letter = lambda k: F.element_at(F.array(*map(F.lit, "abcd")), (seq % k + 1).cast("int"))
    text = F.when((key % 3 == 0) & (seq % 9 < 6), letter(2)).when((key % 3 == 1) & (seq % 13 < 11), F.concat(letter(3), F.lit(","))).when((key % 3 == 2) & (seq % 17 < 14), letter(4)).otherwise(F.col("text"))
    return timed(spark, sf_dir).select("key", "seq", text.alias("text"), SLICE)


def w15_loops_collapsed(spark, sf_dir):
    return sg.without_loops(_loopy(spark, sf_dir)).select("key", "seq", "text")


W15_ALL = f"""WITH RECURSIVE {WORDS}, l AS (
  SELECT key, seq, CASE WHEN key % 3 = 0 AND seq % 9 < 6 THEN ['a', 'b'][seq % 2 + 1] WHEN key % 3 = 1 AND seq % 13 < 11 THEN ['a,', 'b,', 'c,'][seq % 3 + 1] WHEN key % 3 = 2 AND seq % 17 < 14 THEN ['a', 'b', 'c', 'd'][seq % 4 + 1] ELSE text END AS text FROM words
), t AS (SELECT key, count(*) AS n, list(trim(lower(text), '.,!?') ORDER BY seq) AS s FROM l GROUP BY key),
tried AS (
  SELECT key, n, s, i, list_filter([1, 2, 3, 4], lambda k: n >= 6 AND s[i:i + k - 1] = s[i + k:i + 2 * k - 1] AND s[i:i + k - 1] = s[i + 2 * k:i + 3 * k - 1])[1] AS k FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM t)
), jump AS (
  SELECT key, n, i, coalesce(k, 1) AS k, CASE WHEN k IS NULL THEN i + 1 ELSE i + k * list_filter(range(3, n + 2), lambda c: s[i + c * k:i + c * k + k - 1] <> s[i:i + k - 1])[1] END AS nx FROM tried
), walk AS (
  SELECT key, i, k, nx, n FROM jump WHERE i = 1 UNION ALL SELECT j.key, j.i, j.k, j.nx, j.n FROM walk w JOIN jump j ON j.key = w.key AND j.i = w.nx
)
SELECT l.key, l.seq, l.text FROM (SELECT key, unnest(range(i, i + k)) AS seq FROM walk) x JOIN l ON l.key = x.key AND l.seq = x.seq"""


def w15_single_word_loops(spark, sf_dir):
    w = timed(spark, sf_dir).select("key", "seq", F.when(F.col("seq") % 7 < 4, F.lit("Um.")).otherwise(F.col("text")).alias("text"), SLICE)
    return sg.without_loops(w, longest=1).select("key", "seq", "text")


W15 = f"""WITH {WORDS}, t AS (SELECT key, seq, CASE WHEN seq % 7 < 4 THEN 'Um.' ELSE text END AS text FROM words), n AS (SELECT key, count(*) AS n FROM t GROUP BY key),
r AS (SELECT key, seq, text, sum(b) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN lower(rtrim(text, '.')) = lag(lower(rtrim(text, '.'))) OVER (PARTITION BY key ORDER BY seq) THEN 0 ELSE 1 END AS b FROM t)),
k AS (SELECT *, row_number() OVER (PARTITION BY key, run ORDER BY seq) AS i, count(*) OVER (PARTITION BY key, run) AS size, count(*) OVER (PARTITION BY key) AS n FROM r)
SELECT key, seq, text FROM k WHERE n < 6 OR size < 3 OR i = 1"""


def d5_near_doubles(spark, sf_dir):
    w = timed(spark, sf_dir)
    doubled = w.select("key", "seq", "text", "start_sec", "end_sec").union(w.select("key", F.col("seq") + 100000, "text", F.col("start_sec") + 0.03, F.col("end_sec") + 0.04)).union(w.select("key", F.col("seq") + 200000, "text", F.col("start_sec") + 0.06, F.col("end_sec") + 0.06))
    return rounded(sg.without_doubles(doubled), "key", "seq", "text")


D5 = f"""WITH RECURSIVE {WORDS}, d AS (
  SELECT key, seq, text, start_sec, end_sec FROM words UNION ALL SELECT key, seq + 100000, text, start_sec + 0.03, end_sec + 0.04 FROM words UNION ALL SELECT key, seq + 200000, text, start_sec + 0.06, end_sec + 0.06 FROM words
), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start_sec, end_sec, lower(trim(text)), seq) AS k FROM d),
f AS (
  SELECT key, k, seq, lower(text) AS t, start_sec AS a, end_sec AS b, TRUE AS kept FROM o WHERE k = 1
  UNION ALL SELECT key, k, seq, CASE WHEN same THEN t ELSE u END, CASE WHEN same THEN a ELSE s END, CASE WHEN same THEN b ELSE e END, NOT same
  FROM (SELECT f.key, o.k, o.seq, t, a, b, lower(trim(o.text)) AS u, o.start_sec AS s, o.end_sec AS e, t = lower(trim(o.text)) AND abs(o.start_sec - a) <= 0.05 AND abs(o.end_sec - b) <= 0.05 AS same FROM f JOIN o ON o.key = f.key AND o.k = f.k + 1)
)
SELECT d.key, d.seq, d.text, round(start_sec, 3) AS start_sec, round(end_sec, 3) AS end_sec FROM d JOIN f ON d.key = f.key AND d.seq = f.seq WHERE kept"""


def w16_deleted_regions(spark, sf_dir):
    return rounded(sg.deleted_regions(timed(spark, sf_dir).withColumn("deleted", F.col("text").isin("view", "click"))), "key")


W16 = f"""WITH {WORDS}, r AS (SELECT *, sum((text NOT IN ('view', 'click'))::INT) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM words)
SELECT key, round(arg_min(start_sec, seq), 3) AS start_sec, round(arg_max(end_sec, seq), 3) AS end_sec FROM r WHERE text IN ('view', 'click') GROUP BY key, run"""

QUERIES = {
    "s12_mock_words": (s12_mock_words, S12),
    "s13_spread_words": (s13_spread_words, f"WITH {TALK} SELECT key, seq, text, round(start_sec, 3) AS start_sec, round(end_sec, 3) AS end_sec FROM talk"),
    "w11_slot_chunks": (w11_slot_chunks, f"WITH {TALK}, {SPLIT.format(out='c', src='talk', gap=1.1, size=14, ends=AFTER, least=4)} SELECT {OUT} FROM c WHERE chunk <= 12"),
    "w12_sentences": (w12_sentences, f"WITH {TALK}, {SENT} SELECT {OUT} FROM sent"),
    "w13_paragraphs": (w13_paragraphs, f"WITH {TALK}, {SENT}, s2 AS (SELECT key, chunk AS seq, text, start_sec, end_sec FROM sent), {SPLIT.format(out='para', src='s2', gap=1.5, size=3, ends='FALSE', least=1)} SELECT {OUT} FROM para"),
    "w14_captions": (w14_captions, W14),
    "w15_loops_collapsed": (w15_loops_collapsed, W15_ALL),
    "w15_single_word_loops": (w15_single_word_loops, W15),
    "w16_deleted_regions": (w16_deleted_regions, W16),
    "d5_near_doubles": (d5_near_doubles, D5),
}

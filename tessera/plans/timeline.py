"""Queries on clips, edits, versions, prompts, transcripts and jobs, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import edits, jobs, prompts
from tessera.operators import intervals as iv
from tessera.operators import timeline as tl
from tessera.operators import transcripts as ts
from tessera.plans.intervals import GAPS, WORDS, durations, rounded, silences, words
from tessera.sources.stored import dealt
from tessera.sources.tables import ingestible, media_type, silences_of_log, table, words_of_json

LINES = """lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS k FROM lineitem)"""


def clips(spark, sf_dir):
    """An order's lines as clips of one video track."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    rows = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").withColumn("k", F.row_number().over(order))
    return rows.select(F.col("l_orderkey").alias("key"), F.col("k"), F.col("l_partkey").alias("asset_id"), F.lit(0.0).alias("start_sec"), F.col("l_quantity").alias("end_sec"), (1 + F.col("l_discount") * 10).alias("speed"))


def w17_a1_ripple(spark, sf_dir):
    r = tl.rippled(clips(spark, sf_dir), "key", ["k"])
    return r.join(tl.duration(r, "key"), "key").select("key", F.col("k").cast("int").alias("k"), "timeline_start_sec", "duration_sec")


W17 = f"""WITH {LINES}, d AS (SELECT l_orderkey AS key, k, l_quantity / greatest(1 + l_discount * 10, 0.01) AS d FROM lines),
r AS (SELECT key, k, d, round(coalesce(sum(d) OVER (PARTITION BY key ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 3) AS timeline_start_sec FROM d)
SELECT key, CAST(k AS INT) AS k, timeline_start_sec, round(max(timeline_start_sec + d) OVER (PARTITION BY key), 3) AS duration_sec FROM r"""


def w18_transition_layout(spark, sf_dir):
    c = clips(spark, sf_dir).withColumns({"clip_id": F.col("k").cast("long"), "raw_sec": F.col("asset_id") % 7 / 2.0})
    return tl.transition_layout(c, "key", ["k"]).select("key", "clip_id", "render_start_sec", F.round("transition_sec", 3).alias("transition_sec"))


W18 = f"""WITH RECURSIVE {LINES}, c AS (SELECT l_orderkey AS key, k, l_quantity / greatest(1 + l_discount * 10, 0.01) AS d, l_partkey % 7 / 2.0 AS raw FROM lines),
f AS (SELECT key, k, d, 0.0::DOUBLE AS s, 0.0::DOUBLE AS lap FROM c WHERE k = 1
  UNION ALL SELECT f.key, c.k, c.d, greatest(0.0, round(f.s + f.d - greatest(0.0, least(c.raw, 0.45::DOUBLE * least(f.d, c.d))) + 1e-9, 3)), greatest(0.0, least(c.raw, 0.45::DOUBLE * least(f.d, c.d))) FROM f JOIN c ON c.key = f.key AND c.k = f.k + 1)
SELECT key, k AS clip_id, s AS render_start_sec, round(lap, 3) AS transition_sec FROM f"""


def j1_j2_clip_assets(spark, sf_dir):
    """Clips with their assets: one that is missing fails the query on the video track."""
    assets = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset_id"), "p_name", F.lit(True).alias("there"))
    rows = clips(spark, sf_dir).join(assets, "asset_id", "left")
    name = F.when(F.col("there"), F.col("p_name")).otherwise(F.raise_error(F.concat(F.lit("no asset "), F.col("asset_id").cast("string"))))
    return rows.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.round(F.sum("end_sec"), 2).alias("seconds"))


J1 = "SELECT p_name AS name, count(*) AS n, round(sum(l_quantity), 2) AS seconds FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_name"


def w22_volume(spark, sf_dir):
    """Volumes between keyframes (an order's lines), each second."""
    order = Window.partitionBy("key").orderBy("t")
    frames = clips(spark, sf_dir).select("key", F.col("end_sec").alias("t"), (F.col("speed") / 2).alias("v"), "k")
    frames = frames.groupBy("key", "t").agg(F.max_by("v", "k").alias("v")).filter("t > 0").union(frames.select("key").distinct().select("key", F.lit(0.0), F.lit(1.0)))
    spans = frames.select("key", "t", "v", F.lead("t").over(order).alias("t1"), F.lead("v").over(order).alias("v1"))
    at = spans.select("key", F.explode(F.sequence(F.ceil("t").cast("int"), F.coalesce(F.ceil("t1").cast("int") - 1, F.ceil("t").cast("int")))).alias("second"), "t", "v", "t1", "v1")
    value = F.when(F.col("t1").isNull(), F.col("v")).otherwise(F.col("v") + (F.col("v1") - F.col("v")) * (F.col("second") - F.col("t")) / F.greatest(F.col("t1") - F.col("t"), F.lit(0.001)))
    return at.select("key", "second", F.round(value + 1e-9, 4).alias("volume"))


W22 = f"""WITH {LINES}, f AS (SELECT l_orderkey AS key, l_quantity AS t, arg_max((1 + l_discount * 10) / 2, k) AS v FROM lines GROUP BY ALL HAVING l_quantity > 0 UNION ALL SELECT DISTINCT l_orderkey, 0.0::DOUBLE, 1.0::DOUBLE FROM lines),
s AS (SELECT *, lead(t) OVER (PARTITION BY key ORDER BY t) AS t1, lead(v) OVER (PARTITION BY key ORDER BY t) AS v1 FROM f),
a AS (SELECT *, unnest(range(CAST(ceil(t) AS INT), coalesce(CAST(ceil(t1) AS INT), CAST(ceil(t) AS INT) + 1)))::INT AS second FROM s)
SELECT key, second, round(CASE WHEN t1 IS NULL THEN v ELSE v + (v1 - v) * (second - t) / greatest(t1 - t, 0.001) END + 1e-9, 4) AS volume FROM a"""


def w23_ruler(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("dur"), (F.col("p_partkey") % 200).alias("zoom"))
    step = F.when(F.col("zoom") < 20, 10.0).when(F.col("zoom") < 40, 5.0).when(F.col("zoom") < 80, 2.0).when(F.col("zoom") < 150, 1.0).otherwise(0.5)
    rows = p.withColumn("step", step).select("p_partkey", "step", F.explode(F.sequence(F.lit(0), F.floor(F.col("dur") / F.col("step")).cast("int"))).alias("i"))
    sec = F.col("i") * F.col("step")
    return rows.select("p_partkey", sec.alias("sec"), tx.clock_label(sec).alias("label"), (sec % F.when(F.col("step") >= 1, 5.0).otherwise(1.0) == 0).alias("major"))


W23 = """WITH p AS (SELECT p_partkey, p_size::DOUBLE AS dur, CASE WHEN p_partkey % 200 < 20 THEN 10.0 WHEN p_partkey % 200 < 40 THEN 5.0 WHEN p_partkey % 200 < 80 THEN 2.0 WHEN p_partkey % 200 < 150 THEN 1.0 ELSE 0.5 END::DOUBLE AS step FROM part),
r AS (SELECT p_partkey, step, unnest(range(0, CAST(floor(dur / step) AS INT) + 1)) * step AS sec FROM p)
SELECT p_partkey, sec, CAST(floor(sec / 60) AS BIGINT)::VARCHAR || ':' || lpad(CAST(floor(sec % 60) AS BIGINT)::VARCHAR, 2, '0') AS label, sec % CASE WHEN step >= 1 THEN 5.0 ELSE 1.0 END = 0 AS major FROM r"""


def u6_j14_reordered(spark, sf_dir):
    """Clips with the listed ones (those of discount over 5 %, by part) first, laid out anew."""
    c = clips(spark, sf_dir)
    listed = c.filter("speed > 1.5").select("key", "k", F.row_number().over(Window.partitionBy("key").orderBy("asset_id", "k")).alias("pos"))
    rows = c.join(listed, ["key", "k"], "left").withColumn("o", F.coalesce("pos", F.lit(1 << 20) + F.col("k")))
    return tl.rippled(rows, "key", ["o"]).select("key", F.col("k").cast("int").alias("k"), "timeline_start_sec")


U6 = f"""WITH {LINES}, c AS (SELECT l_orderkey AS key, k, l_quantity / (1 + l_discount * 10) AS d, CASE WHEN 1 + l_discount * 10 > 1.5 THEN row_number() OVER (PARTITION BY l_orderkey, 1 + l_discount * 10 > 1.5 ORDER BY l_partkey, k) ELSE 1048576 + k END AS o FROM lines)
SELECT key, CAST(k AS INT) AS k, round(coalesce(sum(d) OVER (PARTITION BY key ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 3) AS timeline_start_sec FROM c"""


def _tracks(spark, sf_dir):
    c = tl.rippled(clips(spark, sf_dir), "key", ["k"])
    rows = c.select(F.col("key").alias("project_id"), F.lit("video").alias("track"), F.col("k").alias("ord"), F.concat(F.lit("c"), F.col("k").cast("string")).alias("clip_id"), F.col("asset_id").cast("string").alias("asset_id"), "start_sec", "end_sec", "timeline_start_sec", "speed")
    return edits.new_clips(rows)


def _ops(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project_id"), (F.col("o_orderkey") % 5).alias("z"))
    kinds = F.array(*map(F.lit, ("delete_clip", "split_clip", "set_speed", "trim_clip", "move_clip")))
    entries = {"clip": F.lit("1"), "at_sec": F.lit("5.5"), "speed": F.lit("9"), "start_sec": F.lit("1"), "end_sec": F.lit("3.5"), "timeline_start_sec": F.lit("1000"), "ripple": F.lit("false")}
    return o.select("project_id", F.lit(1).alias("seq"), F.get(kinds, F.col("z").cast("int")).alias("op_type"), F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)]).alias("params"))


def v0_operations(spark, sf_dir):
    out = edits.apply_log(_tracks(spark, sf_dir), _ops(spark, sf_dir), 1)
    return out.select("project_id", "clip_id", F.col("ord").cast("int").alias("ord"), "start_sec", "end_sec", "timeline_start_sec", F.round("speed", 6).alias("speed"))


V0 = f"""WITH {LINES}, c AS (SELECT l_orderkey AS p, k, l_quantity AS q, 1 + l_discount * 10 AS v, l_orderkey IN (SELECT o_orderkey FROM orders) AS op,
    round(coalesce(sum(l_quantity / (1 + l_discount * 10)) OVER (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 3) AS t FROM lines),
m AS (SELECT *, CASE WHEN op THEN p % 5 END AS z FROM c),
e AS (
  SELECT p, 'c' || k AS clip_id, k::DOUBLE AS o, 0.0::DOUBLE AS a, q AS b, t, v, z FROM m WHERE z IS NULL OR NOT (z = 0 AND k = 1) AND NOT (z IN (1, 2, 3, 4) AND k = 1)
  UNION ALL SELECT p, 'c1', 1, 0.0, CASE WHEN q > 5.5 THEN 5.5 ELSE q END, t, v, z FROM m WHERE z = 1 AND k = 1
  UNION ALL SELECT p, 'c1''', 1.5, 5.5, q, round(t + 5.5 / v, 3), v, z FROM m WHERE z = 1 AND k = 1 AND q > 5.5
  UNION ALL SELECT p, 'c1', 1, 0.0, q, t, 4.0, z FROM m WHERE z = 2 AND k = 1
  UNION ALL SELECT p, 'c1', 1, 1.0, 3.5, t, v, z FROM m WHERE z = 3 AND k = 1
  UNION ALL SELECT p, 'c1', 1, 0.0, q, 1000.0, v, z FROM m WHERE z = 4 AND k = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY CASE WHEN z = 4 THEN t ELSE 0 END, o) AS ord FROM e)
SELECT p AS project_id, clip_id, CAST(ord AS INT) AS ord, a AS start_sec, b AS end_sec, round(v, 6) AS speed,
  CASE WHEN z = 0 THEN round(coalesce(sum((b - a) / v) OVER (PARTITION BY p ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 3) ELSE t END AS timeline_start_sec FROM n"""


def _log(spark, sf_dir):
    action = F.when(F.col("o_orderstatus") == "F", "undo").when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 2 == 0), "redo").otherwise("save")
    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), seq.alias("seq"), action.alias("action"))


def v1_v2_v3_versions(spark, sf_dir):
    return edits.versions(_log(spark, sf_dir))


V1 = """WITH RECURSIVE l AS (SELECT o_custkey AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, CASE WHEN o_orderstatus = 'F' THEN 'undo' WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'redo' ELSE 'save' END AS x FROM orders),
f AS (SELECT DISTINCT p, 0::BIGINT AS k, 0 AS h, 0 AS t FROM l
  UNION ALL SELECT f.p, l.k, CASE WHEN x = 'save' THEN h + 1 WHEN x = 'undo' AND h > 0 THEN h - 1 WHEN x = 'redo' AND h < t THEN h + 1 ELSE h END, CASE WHEN x = 'save' THEN h + 1 ELSE t END FROM f JOIN l ON l.p = f.p AND l.k = f.k + 1)
SELECT p AS project_id, arg_max(h, k) AS head, arg_max(t, k) AS top FROM f GROUP BY p"""


def v4_l7_history(spark, sf_dir):
    return _log(spark, sf_dir).withColumn("back", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("seq")))).select("project_id", "seq", "action", "back")


V4 = """WITH l AS (SELECT o_custkey AS project_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, CASE WHEN o_orderstatus = 'F' THEN 'undo' WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'redo' ELSE 'save' END AS action FROM orders)
SELECT project_id, CAST(seq AS INT) AS seq, action, CAST(back AS INT) AS back FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY seq DESC) AS back FROM l)"""


def f6_prompts(spark, sf_dir):
    """Commands about orders, in several wordings."""
    o = table(spark, sf_dir, "orders").withColumn("z", F.col("o_orderkey") % 10)
    k, s = (F.col("o_custkey") % 9 + 1).cast("string"), (F.col("o_orderkey") % 50).cast("string")
    said = F.when(F.col("z") == 0, F.concat(F.lit("Please trim first clip from "), s, F.lit(" sec to 1:40"))).when(F.col("z") == 1, F.concat(F.lit("split clip #"), k, F.lit("  at 00:"), F.lpad(s, 2, "0"), F.lit("!")))
    said = said.when(F.col("z") == 2, F.concat(F.lit("SET SPEED clip "), k, F.lit(" to 1.5x"))).when(F.col("z") == 3, F.concat(F.lit("mute clip "), k, F.lit(" please"))).when(F.col("z") == 4, F.concat(F.lit("delete clip "), k))
    said = said.when(F.col("z") == 5, F.concat(F.lit("move clip "), k, F.lit(" to "), s, F.lit(":5"))).when(F.col("z") == 6, F.concat(F.lit("merge clips "), k, F.lit(", 12")))
    said = said.when(F.col("z") == 7, F.concat(F.lit('could you add text "'), s, F.lit(' second clip" at 3 pls?'))).when(F.col("z") == 8, F.concat(F.lit("kindly rotate clip one "), F.lit("90 deg"))).otherwise("dance")
    out = prompts.parsed(o.select("o_orderkey", said.alias("prompt")))
    return out.select("o_orderkey", F.coalesce("op_type", F.lit("-")).alias("op_type"), F.coalesce(F.col("params")["clip"], F.col("params")["clips"], F.col("params")["text"], F.lit("-")).alias("clip"), F.round(F.coalesce(F.col("params")["at_sec"], F.col("params")["end_sec"], F.col("params")["speed"]).cast("double"), 3).alias("x"), "confidence", F.coalesce("error", F.lit("-")).alias("error"))


F6 = """WITH o AS (SELECT o_orderkey, o_orderkey % 10 AS z, (o_custkey % 9 + 1)::VARCHAR AS k, (o_orderkey % 50)::DOUBLE AS s FROM orders)
SELECT o_orderkey, ['trim_clip','split_clip','set_speed','set_volume','delete_clip','-','merge_clips','add_text_overlay','-','-'][z + 1] AS op_type, CASE z WHEN 0 THEN '1' WHEN 5 THEN '-' WHEN 6 THEN k || ',12' WHEN 7 THEN s::INT || 's clip' WHEN 8 THEN '-' WHEN 9 THEN '-' ELSE k END AS clip,
  CASE z WHEN 0 THEN 100.0 WHEN 1 THEN s WHEN 2 THEN 1.5 END::DOUBLE AS x, [0.97, 0.97, 0.97, 0.95, 0.97, 0.0, 0.97, 0.97, 0.0, 0.0][z + 1]::DOUBLE AS confidence, ['-','-','-','-','-','invalid timecode','-','-','unknown command','unknown command'][z + 1] AS error FROM o"""


def p1_p2_normalised(spark, sf_dir):
    w = words(spark, sf_dir).withColumn("text", F.concat(F.lit("  "), "text", F.lit("  x ")))
    d = durations(w).select("key", (F.col("duration_sec") - 5010.0).alias("duration_sec"))
    return ts.normalised(w, d)


P1 = f"""WITH {WORDS}, d AS (SELECT key, duration_sec - 5010.0 AS dur FROM durations), c AS (
  SELECT key, seq, text || ' x' AS text, start_sec, round(greatest(0.0, least(start_sec, dur)), 3) AS a, round(greatest(0.0, least(end_sec, dur)), 3) AS b, dur, confidence FROM words JOIN d USING (key))
SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY start_sec, seq) AS INT) AS seq, text, a AS start_sec, CASE WHEN b <= a THEN round(least(dur, a + 0.05), 3) ELSE b END AS end_sec, confidence FROM c WHERE confidence IS NULL OR confidence >= 0.15"""


def a2_a3_a4_quality(spark, sf_dir):
    w = words(spark, sf_dir)
    d = durations(w).select("key", (F.col("duration_sec") / 20000).alias("duration_sec"))
    return rounded(ts.quality(w.withColumns({"start_sec": F.col("start_sec") / 20000, "end_sec": F.col("end_sec") / 20000}), d), "key", "n", "n_scored", "n_low", "low_coverage", "low_confidence")


A2 = f"""WITH {WORDS}, {GAPS}, g AS (SELECT key, greatest(0.0, max(b - a)) / 20000 AS g FROM all_gaps GROUP BY key),
s AS (SELECT key, count(*) AS n, count(confidence) AS n_scored, count(*) FILTER (confidence < 0.6) AS n_low, coalesce(avg(confidence), 1.0) AS av, max(end_sec) / 20000 AS last FROM words GROUP BY key)
SELECT key, round(duration_sec / 20000, 3) AS duration_sec, n, n_scored, n_low, round(av, 3) AS avg_confidence, round(g, 3) AS max_gap, round(greatest(0.0, least(1.0, last / greatest(duration_sec / 20000, 0.1))), 3) AS coverage,
  n < greatest(8, CAST(round_even(greatest(duration_sec / 20000, 1.0) * 0.45, 0) AS INT)) AS low_coverage, n_scored >= 30 AND n_low / greatest(n_scored, 1) >= 0.18 AS low_confidence FROM durations JOIN s USING (key) JOIN g USING (key)"""


def a5_profile(spark, sf_dir):
    w = words(spark, sf_dir)
    return rounded(ts.profile(silences(w).withColumn("end_sec", F.col("end_sec") + F.col("key") * 40.0), durations(w), 1200000.0), "key", "profile")


A5 = f"""WITH {WORDS}, x AS (SELECT d.key, least(duration_sec, 1200000.0) AS n, coalesce((SELECT sum(greatest(0.0, least(end_sec + s.key * 40.0, least(duration_sec, 1200000.0)) - greatest(start_sec, 0.0))) FROM silences s WHERE s.key = d.key), 0.0) AS s FROM durations d),
r AS (SELECT key, greatest(0.0, least(1.0, s / greatest(n, 0.1))) AS r FROM x) SELECT key, round(r, 3) AS silence, CASE WHEN r >= 0.10 THEN 'speech' WHEN r <= 0.04 THEN 'music' ELSE 'mixed' END AS profile FROM r"""


def _second(w):
    return w.filter("word_id % 4 <> 0").withColumns({"confidence": F.col("confidence") * 0.9 + 0.1, "end_sec": F.col("end_sec") + F.col("key") % 3 * 40000.0})


def e8_better(spark, sf_dir):
    w = words(spark, sf_dir)
    d = durations(w)
    return ts.better(ts.quality(w, d), ts.quality(_second(w), d))


E8 = f"""WITH {WORDS}, w2 AS (SELECT key, seq, start_sec, end_sec + key % 3 * 40000.0 AS end_sec, confidence * 0.9 + 0.1 AS confidence FROM words WHERE word_id % 4 <> 0),
both_words AS (SELECT 1 AS t, key, start_sec, end_sec, confidence FROM words UNION ALL SELECT 2, key, start_sec, end_sec, confidence FROM w2),
gg AS (SELECT t, key, coalesce(lag(end_sec) OVER (PARTITION BY t, key ORDER BY start_sec, end_sec), 0.0) AS a, start_sec AS b FROM both_words
  UNION ALL SELECT t, key, arg_max(end_sec, row(start_sec, end_sec)), any_value(duration_sec) FROM both_words JOIN durations USING (key) GROUP BY t, key),
g AS (SELECT t, key, greatest(0.0, coalesce(max(b - a) FILTER (b > a), 0.0)) AS g FROM gg GROUP BY t, key),
q AS (SELECT t, key, count(*) AS n, count(confidence) AS ns, count(*) FILTER (confidence < 0.6) AS nl, coalesce(avg(confidence), 1.0) AS av, any_value(duration_sec) AS dur, greatest(0.0, least(1.0, max(end_sec) / greatest(any_value(duration_sec), 0.1))) AS cov FROM both_words JOIN durations USING (key) GROUP BY t, key),
z AS (SELECT q.*, g, n < greatest(8, CAST(round_even(greatest(dur, 1.0) * 0.45, 0) AS INT)) AS low FROM q JOIN g USING (t, key))
SELECT a.key, CASE WHEN b.n IS NULL THEN 'first' WHEN a.low AND NOT b.low THEN 'second' WHEN b.n >= a.n + greatest(12, CAST(round_even(a.n * 0.15, 0) AS INT)) THEN 'second' WHEN b.cov >= a.cov + 0.08 THEN 'second' WHEN b.g + 5.0 <= a.g THEN 'second'
  WHEN a.ns >= 30 AND b.ns >= 30 AND b.nl / greatest(b.ns, 1) + 0.05 <= a.nl / greatest(a.ns, 1) THEN 'second' WHEN a.ns >= 30 AND b.ns >= 30 AND b.nl / greatest(b.ns, 1) <= a.nl / greatest(a.ns, 1) + 0.01 AND b.av >= a.av + 0.03 THEN 'second' ELSE 'first' END AS take
FROM (SELECT * FROM z WHERE t = 1) a LEFT JOIN (SELECT * FROM z WHERE t = 2) b ON a.key = b.key"""


def e9_gap_filled(spark, sf_dir):
    w = words(spark, sf_dir)
    return rounded(ts.gap_filled(w.filter("text <> 'view'"), w, durations(w), 50000.0, 20.0), "key", "seq", "text").drop("seq")


def e10_l5_rescue_windows(spark, sf_dir):
    w = words(spark, sf_dir)
    return rounded(ts.rescue_windows(iv.gaps(w, durations(w), 50000.0), 30000.0, 12), "key", "window")


E10 = f"""WITH {WORDS}, {GAPS}, g AS (SELECT key, a, b, b - a AS size, greatest(CAST(ceil((b - a) / 30000.0) AS INT), 1) AS n FROM all_gaps WHERE b - a >= 50000.0 AND b > a),
p AS (SELECT key, a, b, size, unnest(range(0, n))::INT AS piece FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY size DESC, a, piece) AS w FROM p)
SELECT key, CAST(w AS INT) AS "window", round(a + piece * 30000.0, 3) AS start_sec, round(least(a + (piece + 1) * 30000.0, b), 3) AS end_sec FROM r WHERE w <= 12"""


def p11_same_script(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("key"), F.col("doc_id").alias("seq"), F.col("doc_id").cast("double").alias("start_sec"), F.col("doc_id").cast("double").alias("end_sec"), "text")
    w = d.select("key", (F.col("seq") * 100000 + 1).alias("seq"), "start_sec", "end_sec", F.explode(F.split("text", " ")).alias("text"))
    return ts.same_script(d, w).groupBy("key").agg(F.count("*").alias("n"))


P11 = r"""WITH d AS (SELECT doc_id % 50 AS key, doc_id, text FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS r FROM d),
l AS (SELECT key, sum(length(regexp_replace(text, '[^\p{L}]', '', 'g'))) AS al, sum(length(regexp_replace(text, '[^A-Za-z]', '', 'g'))) AS asc_ FROM f WHERE r <= 600 GROUP BY key),
w AS (SELECT key, unnest(string_split(text, ' ')) AS t FROM d), x AS (SELECT key, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS n, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS m FROM w)
SELECT key, count(*) AS n FROM x JOIN l USING (key) WHERE NOT (al >= 40 AND asc_ >= 0.65 * al AND n >= 2 AND (n > m OR m / greatest(n, 1) < 0.35)) GROUP BY key"""


def k4_edited_text(spark, sf_dir):
    w = words(spark, sf_dir)
    return ts.edited_text(w, w.filter("text = 'error'").select("key", "seq", F.lit("mistake").alias("new_text")))


K4 = f"WITH {WORDS} SELECT key, string_agg(CASE WHEN text = 'error' THEN 'mistake' ELSE text END, ' ' ORDER BY seq) AS text FROM words GROUP BY key"


def a7_waveform(spark, sf_dir):
    return ts.waveform(words(spark, sf_dir).select("key", (F.col("seq") - 1).alias("idx"), (F.col("confidence") * 2 - 1.1).alias("value")).fillna(0.0), 20).select("key", "peak", F.round("value", 6).alias("value"))


A7 = f"""WITH {WORDS}, s AS (SELECT key, seq - 1 AS idx, coalesce(confidence * 2 - 1.1, 0.0) AS v, greatest(count(*) OVER (PARTITION BY key) // 20, 1) AS c FROM words),
p AS (SELECT key, CAST(idx // c AS INT) AS peak, least(max(abs(v)), 1.0) AS v FROM s GROUP BY key, idx // c) SELECT key, peak, round(CASE WHEN max(v) OVER (PARTITION BY key) > 0 THEN v / max(v) OVER (PARTITION BY key) ELSE 0.0 END, 6) AS value FROM p"""


def _job_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "queued").otherwise("running")
    return e.select((F.col("user_id") * 40 + F.col("event_id") % 40).alias("job_id"), (F.col("user_id") % 10).alias("project_id"), F.when(F.col("event_id") % 2 == 0, "render").otherwise("ingest").alias("kind"), F.col("event_type").alias("stage"), status.alias("status"), "event_id", F.col("ts").alias("created_at"))


JOBS = """je AS (SELECT user_id * 40 + event_id % 40 AS job_id, user_id % 10 AS project_id, CASE WHEN event_id % 2 = 0 THEN 'render' ELSE 'ingest' END AS kind, event_type AS stage,
  CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'queued' ELSE 'running' END AS status, event_id, ts AS created_at FROM events)"""


def e1_k5_active_jobs(spark, sf_dir):
    return jobs.active_jobs(_job_events(spark, sf_dir))


E1 = f"""WITH {JOBS}, l AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, event_id DESC) AS r FROM je)
SELECT project_id, kind, job_id, status FROM (SELECT *, row_number() OVER (PARTITION BY project_id, kind ORDER BY created_at DESC, event_id DESC) AS q FROM l WHERE r = 1 AND status IN ('queued', 'running')) WHERE q = 1"""


def e2_orphans(spark, sf_dir):
    return jobs.orphans(_job_events(spark, sf_dir))


E2 = f"WITH {JOBS} SELECT DISTINCT job_id, 'failed' AS status, 100 AS progress FROM je WHERE job_id NOT IN (SELECT job_id FROM je WHERE status IN ('completed', 'failed'))"


def e3_e4_stage_times(spark, sf_dir):
    s = jobs.stage_times(_job_events(spark, sf_dir))
    return s.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.avg("seconds"), 2).alias("mean"), F.count("seconds").alias("n_known"))


E3 = f"WITH {JOBS}, s AS (SELECT stage, (epoch_us(lead(created_at) OVER (PARTITION BY job_id ORDER BY created_at, event_id)) - epoch_us(created_at)) / 1e6 AS seconds FROM je) SELECT stage, count(*) AS n, round(avg(seconds), 2) AS mean, count(seconds) AS n_known FROM s GROUP BY stage"


def _stage_events(spark, sf_dir):
    """Job logs in which stages are skipped, come twice, have a wrong progress, or come after the end."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") * 4 + F.col("event_id") % 4).alias("job_id"), (F.col("user_id") % 10).alias("project_id"), "event_id", F.col("ts").alias("created_at"))
    kind = F.when(F.col("job_id") % 2 == 0, "render").otherwise("ingest")
    e = e.withColumn("kind", kind).withColumn("n", F.row_number().over(Window.partitionBy("job_id").orderBy("created_at", "event_id")))
    names = F.when(F.col("kind") == "render", F.array(*[F.lit(x) for x, *_ in jobs.STAGES["render"]])).otherwise(F.array(*[F.lit(x) for x, *_ in jobs.STAGES["ingest"]]))
    shift = F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    stage = F.when(F.col("event_id") % 23 == 0, "failed").when(F.col("event_id") % 29 == 0, "dancing").otherwise(F.get(names, ((F.col("n") - 1 - F.floor(F.col("n") / 5) + shift) % F.size(names)).cast("int")))
    rows = e.withColumn("stage", stage)
    progress = F.when(F.col("event_id") % 31 == 0, 50)
    status = F.lit("running")
    for name, state, done in [x for steps in jobs.STAGES.values() for x in steps] + [jobs.FAILED]:
        status = F.when(F.col("stage") == name, state).otherwise(status)
        progress = F.coalesce(progress, F.when(F.col("stage") == name, done))
    return rows.select("job_id", "project_id", "kind", "event_id", "created_at", "stage", status.alias("status"), F.coalesce(progress, F.lit(1)).alias("progress"))


def e4_e5_refused_events(spark, sf_dir):
    return jobs.run_through(_stage_events(spark, sf_dir)).select("job_id", "event_id", F.coalesce("state", F.lit("-")).alias("state"), F.coalesce("error", F.lit("-")).alias("error"))


def e4_e5_job_states(spark, sf_dir):
    return jobs.job_states(_stage_events(spark, sf_dir), 200000.0).withColumn("state", F.coalesce("state", F.lit("-")))


STEPS = """RECURSIVE steps(kind, pos, stage, status, progress) AS (VALUES
  ('render', 0, 'queued', 'queued', 0), ('render', 1, 'running', 'running', 5), ('render', 2, 'build', 'running', 20), ('render', 3, 'render', 'running', 35), ('render', 4, 'complete', 'completed', 100), ('render', 9, 'failed', 'failed', 100),
  ('ingest', 0, 'queued', 'queued', 0), ('ingest', 1, 'running', 'running', 5), ('ingest', 2, 'download', 'running', 20), ('ingest', 3, 'probe', 'running', 70), ('ingest', 4, 'register', 'running', 85), ('ingest', 5, 'complete', 'completed', 100), ('ingest', 9, 'failed', 'failed', 100)
), raw AS (
  SELECT user_id * 4 + event_id % 4 AS job_id, user_id % 10 AS project_id, event_id, ts AS created_at, CASE WHEN (user_id * 4 + event_id % 4) % 2 = 0 THEN 'render' ELSE 'ingest' END AS kind FROM events
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at, event_id) AS n, CASE kind WHEN 'render' THEN ['queued', 'running', 'build', 'render', 'complete'] ELSE ['queued', 'running', 'download', 'probe', 'register', 'complete'] END AS names FROM raw
), named AS (
  SELECT *, CASE WHEN event_id % 23 = 0 THEN 'failed' WHEN event_id % 29 = 0 THEN 'dancing' ELSE names[(n - 1 - n // 5 + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) % len(names) + 1] END AS stage FROM ranked
), e AS (
  SELECT job_id, project_id, n.kind, event_id, created_at, n, n.stage, s.pos, CASE WHEN event_id % 31 = 0 THEN 50 ELSE coalesce(s.progress, 1) END AS progress, s.pos IS NOT NULL AND (event_id % 31 <> 0 OR s.progress = 50) AS fits
  FROM named n LEFT JOIN steps s ON s.kind = n.kind AND s.stage = n.stage
), f AS (
  SELECT job_id, 0::BIGINT AS n, -1 AS pos, '-' AS state, NULL::BIGINT AS event_id, NULL::VARCHAR AS was, NULL::VARCHAR AS error FROM (SELECT DISTINCT job_id FROM e)
  UNION ALL SELECT f.job_id, e.n, CASE WHEN ok THEN e.pos ELSE f.pos END, CASE WHEN ok THEN e.stage ELSE f.state END, e.event_id, f.state,
    CASE WHEN ok THEN '-' WHEN e.pos IS NULL THEN 'unknown stage' WHEN NOT e.fits THEN 'wrong status or progress' WHEN f.state IN ('complete', 'failed') THEN 'ended' ELSE 'out of order' END
  FROM f JOIN e ON e.job_id = f.job_id AND e.n = f.n + 1,
    LATERAL (SELECT e.fits AND (e.pos = f.pos + 1 OR (e.pos = 9 AND f.pos >= 0)) AND f.state NOT IN ('complete', 'failed') AS ok)
)"""
E45 = f"WITH {STEPS} SELECT job_id, event_id, was AS state, error FROM f WHERE n > 0"
E45_STATES = f"""WITH {STEPS}, l AS (SELECT job_id, arg_max(state, n) AS state, count(*) - 1 AS n_events, count(*) FILTER (error <> '-') AS n_refused FROM f GROUP BY job_id),
p AS (SELECT f.job_id, arg_max(e.progress, f.n) AS progress FROM f JOIN e ON e.job_id = f.job_id AND e.n = f.n WHERE error = '-' GROUP BY f.job_id),
h AS (SELECT job_id, any_value(project_id) AS project_id, any_value(kind) AS kind, max(created_at) AS heard FROM e GROUP BY job_id)
SELECT l.job_id, project_id, kind, state, CAST(coalesce(progress, 0) AS INTEGER) AS progress, n_events, n_refused,
  (epoch_us((SELECT max(ts) FROM events)) - epoch_us(heard)) / 1e6 > 200000.0 AND state NOT IN ('complete', 'failed') AS silent
FROM l JOIN h ON h.job_id = l.job_id LEFT JOIN p ON p.job_id = l.job_id"""


def e6_s9_stream_flags(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit('{"has_audio": true}')).when(F.col("event_id") % 3 == 1, F.col("props")).alias("m"), F.when(F.col("event_id") % 2 == 0, F.col("value") > 50).alias("p"))
    return e.select("event_id", jobs.stream_flag(F.col("m"), "has_audio", F.col("p")).alias("has_audio"))


E6 = "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN TRUE END, CASE WHEN event_id % 2 = 0 THEN value > 50 END, FALSE) AS has_audio FROM events"


def s3_latest_per_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id"), "event_type", "event_id", F.col("ts").alias("created_at"))
    return jobs.latest(e, "user_id").select("user_id", "event_type", "event_id")


S3 = "SELECT user_id, arg_max(event_type, row(ts, event_id)) AS event_type, arg_max(event_id, row(ts, event_id)) AS event_id FROM events GROUP BY user_id"


def s6_s5_json_words(spark, sf_dir):
    """Conversations as JSON arrays of words, some broken, read leniently."""
    c = table(spark, sf_dir, "conversations")
    item = F.concat(F.lit('{"id":"'), F.col("turn").cast("string"), F.lit('","text":"'), F.col("role"), F.lit('","start_sec":"'), (10 - F.col("turn")).cast("string"), F.lit('","end_sec":'), F.when(F.col("turn") % 3 == 0, F.lit('"x"')).otherwise((11.5 - F.col("turn")).cast("string")), F.lit("}"))
    j = c.groupBy("conv_id").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(item)), ","), F.when(F.col("conv_id") % 10 == 0, "").otherwise("]")).alias("j"))
    return words_of_json(j, "conv_id", "j").select("key", "seq", "word_id", "text", "start_sec", "end_sec")


S6 = """SELECT conv_id AS key, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY 10 - turn) AS INT) AS seq, turn::VARCHAR AS word_id, role AS text, (10 - turn)::DOUBLE AS start_sec, (11.5 - turn)::DOUBLE AS end_sec FROM conversations WHERE turn % 3 <> 0 AND conv_id % 10 <> 0"""


def s10_silence_log(spark, sf_dir):
    """Silence logs written from events and read back."""
    w = words(spark, sf_dir)
    line = F.concat(F.lit("silence_start: "), F.round("start_sec", 2).cast("decimal(20,2)").cast("string"), F.lit("\nsilence_end: "), F.round(F.col("start_sec") + F.col("seq") % 4 * 3.5, 2).cast("decimal(20,2)").cast("string"))
    logs = w.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("l")))), lambda x: x.l), "\n").alias("log"))
    return silences_of_log(logs, "key", "log")


S10 = f"""WITH RECURSIVE {WORDS}, l AS (SELECT key, seq, round(start_sec, 2) AS s, round(start_sec + seq % 4 * 3.5, 2) AS e FROM words), ends AS (SELECT key, list(e ORDER BY seq) AS es, list(s ORDER BY seq) AS ss FROM l GROUP BY key),
f AS (SELECT key, es, ss, 0 AS i, 0 AS p, NULL::DOUBLE AS a, NULL::DOUBLE AS b FROM ends
  UNION ALL SELECT key, es, ss, i + 1, coalesce(q, len(es)), ss[i + 1], CASE WHEN q IS NOT NULL THEN es[q] END FROM (
    SELECT key, es, ss, i, list_filter(range(p + 1, len(es) + 1), lambda j: es[j] > ss[i + 1])[1] AS q FROM f WHERE i < len(ss)))
SELECT key, round(a, 3) AS start_sec, round(b, 3) AS end_sec FROM f WHERE b IS NOT NULL"""


def s8_s16_k7_f10_files(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    name = tx.file_name_of(F.col("url"))
    mime = F.when(F.col("page_id") % 3 == 0, "Audio/ogg").when(F.col("page_id") % 3 == 1, "x/y")
    file = F.concat(F.lit("f"), F.get(F.array(*map(F.lit, (".MP4", ".wav", ".txt", "", ".gif"))), (F.col("page_id") % 5).cast("int")))
    return p.select("page_id", ingestible(F.col("url")).alias("ok"), media_type(mime, file).alias("kind"), name.alias("name"), tx.public_path(F.col("page_id").cast("string")).alias("public"), tx.resolved_path(F.concat(F.when(F.col("page_id") % 2 == 0, "/").otherwise(""), F.col("page_id").cast("string")), "/data/").alias("stored"))


S8 = """SELECT page_id, TRUE AS ok, CASE WHEN page_id % 3 = 0 THEN 'audio' ELSE ['video','audio','unknown','unknown','image'][page_id % 5 + 1] END AS kind,
  (CASE WHEN stem = '' THEN 'broll' ELSE stem END) || '.mp4' AS name, '/static/uploads/' || page_id AS public, CASE WHEN page_id % 2 = 0 THEN '/' ELSE '/data/' END || page_id AS stored
FROM (SELECT page_id, regexp_replace(regexp_extract(regexp_extract(url, '^[^?#]*'), '([^/]*)/*$', 1), '\\.[^.]+$', '') AS stem FROM pages)"""

QUERIES = {
    "w17_a1_ripple": (w17_a1_ripple, W17),
    "w18_transition_layout": (w18_transition_layout, W18),
    "w22_volume_keyframes": (w22_volume, W22),
    "w23_ruler_ticks": (w23_ruler, W23),
    "u6_j14_reordered": (u6_j14_reordered, U6),
    "j1_j2_clip_assets": (j1_j2_clip_assets, J1),
    "v0_operations": (v0_operations, V0),
    "v1_v2_v3_versions": (v1_v2_v3_versions, V1),
    "v4_l7_history": (v4_l7_history, V4),
    "f6_prompts": (f6_prompts, F6),
    "p1_p2_normalised": (p1_p2_normalised, P1),
    "a2_a3_a4_quality": (a2_a3_a4_quality, A2),
    "a5_profile": (a5_profile, A5),
    "a7_waveform": (a7_waveform, A7),
    "e8_better_transcript": (e8_better, E8),
    "e9_gap_filled": (e9_gap_filled, None),
    "e10_l5_rescue_windows": (e10_l5_rescue_windows, E10),
    "p11_same_script": (p11_same_script, P11),
    "k4_edited_text": (k4_edited_text, K4),
    "e1_k5_active_jobs": (e1_k5_active_jobs, E1),
    "e2_orphans": (e2_orphans, E2),
    "e3_e4_stage_times": (e3_e4_stage_times, E3),
    "e4_e5_refused_events": (e4_e5_refused_events, E45),
    "e4_e5_job_states": (e4_e5_job_states, E45_STATES),
    "e6_s9_stream_flags": (e6_s9_stream_flags, E6),
    "s3_latest_per_key": (s3_latest_per_key, S3),
    "s5_s6_json_words": (s6_s5_json_words, S6),
    "s10_silence_log": (s10_silence_log, S10),
    "s8_s16_k7_f10_files": (s8_s16_k7_f10_files, S8),
}

"""Queries on scans, sets, slots and other small steps, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import numeric as num
from tessera.functions import text as tx
from tessera.operators import documents
from tessera.operators import slots as sl
from tessera.operators.scan import scanned, so_far, spread
from tessera.operators.transcripts import least_words
from tessera.plans.intervals import WORDS, durations, silences, words
from tessera.sources.tables import table


def s1_s2_scans(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return o.select("o_orderkey", "o_custkey", "o_totalprice")


def s4_projects(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n"), "last")


S4 = "SELECT c_custkey, c_name, count(o_orderkey) AS n, max(o_orderkey) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2"


def p8_low_confidence(spark, sf_dir):
    w = words(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") < 0.6).alias("low"))
    return w.withColumn("warn", (F.col("n") >= 30) & (F.col("low") / F.col("n") >= 0.18))


P8 = f"WITH {WORDS} SELECT key, count(*) AS n, count(*) FILTER (confidence < 0.6) AS low, count(*) >= 30 AND count(*) FILTER (confidence < 0.6) / count(*) >= 0.18 AS warn FROM words GROUP BY key"


def p12_p14_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kind = F.get(F.array(*map(F.lit, ("pexels_video", "pixabay_video", "project_asset", "other"))), (F.col("p_partkey") % 4).cast("int"))
    part = {k: F.when(F.col("p_partkey") % m != 0, F.col("p_size") / 50.0) for k, m in (("semantic", 2), ("entity", 3), ("metadata", 5), ("duration", 7))}
    sure = F.coalesce(F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") / 40.0), F.col("p_size") / 60.0)
    return p.select("p_partkey", tx.source_tag(kind).alias("tag"), F.array_join(tx.breakdown_chips(part), "|").alias("chips"), F.round(num.clamp(sure), 3).alias("confidence"))


P12 = """SELECT p_partkey, ['Pexels','Pixabay','Library','other'][p_partkey % 4 + 1] AS tag, array_to_string(list_filter([
  CASE WHEN p_partkey % 2 <> 0 THEN 'semantic ' || CAST(round(p_size / 50.0 * 100) AS BIGINT) || '%' END, CASE WHEN p_partkey % 3 <> 0 THEN 'entity ' || CAST(round(p_size / 50.0 * 100) AS BIGINT) || '%' END,
  CASE WHEN p_partkey % 5 <> 0 THEN 'metadata ' || CAST(round(p_size / 50.0 * 100) AS BIGINT) || '%' END, CASE WHEN p_partkey % 7 <> 0 THEN 'duration ' || CAST(round(p_size / 50.0 * 100) AS BIGINT) || '%' END], lambda x: x IS NOT NULL)[1:3], '|') AS chips,
  round(least(1.0::DOUBLE, CASE WHEN p_partkey % 3 = 0 THEN p_size / 40.0 ELSE p_size / 60.0 END), 3) AS confidence FROM part"""


def p16_settings(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    flag = F.get(F.array(*map(F.lit, (" TRUE", "off", "x", "1", ""))), (F.col("event_id") % 5).cast("int"))
    number = F.when(F.col("event_id") % 2 == 0, F.col("value").cast("string")).otherwise("n/a")
    return e.select("event_id", tx.truthy(flag, True).alias("flag"), tx.number_setting(number, "double", 7.5, 5.0).alias("number"), F.size(tx.listed(F.concat("event_type", F.lit(", ,b,")))).alias("items"))


P16 = "SELECT event_id, [TRUE, FALSE, TRUE, TRUE, TRUE][event_id % 5 + 1] AS flag, CASE WHEN event_id % 2 = 0 THEN greatest(value, 5.0) ELSE 7.5 END AS number, 2 AS items FROM events"


def _slots(w):
    d = durations(w)
    s = w.select("key", F.col("word_id").alias("slot_id"), "start_sec", (F.col("start_sec") + 20000.0).alias("end_sec"), F.when(F.col("word_id") % 3 == 0, F.array(F.col("word_id"), F.col("word_id") - 1)).otherwise(F.array().cast("array<bigint>")).alias("anchors"), F.lit("general scene").alias("concept"))
    return s.withColumn("start_sec", F.when(F.col("slot_id") % 5 == 0, F.col("start_sec") + 5000.0).otherwise(F.col("start_sec"))).join(d.select("key"), "key")


def j6_slot_texts(spark, sf_dir):
    w = words(spark, sf_dir)
    return sl.slot_texts(_slots(w), w)


J6 = f"""WITH {WORDS}, s AS (SELECT key, word_id AS slot_id, start_sec + CASE WHEN word_id % 5 = 0 THEN 5000.0 ELSE 0.0 END AS a, start_sec + 20000.0 AS b, text FROM words)
SELECT slot_id, coalesce(CASE WHEN slot_id % 3 = 0 THEN text || coalesce((SELECT ' ' || text FROM words w WHERE w.key = s.key AND w.word_id = slot_id - 1), '') END,
  (SELECT string_agg(text, ' ' ORDER BY seq) FROM words w WHERE w.key = s.key AND w.start_sec < b AND w.end_sec > a), 'general scene') AS text FROM s"""


def j13_chosen_overlays(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    chosen = line.groupBy(F.col("l_suppkey").alias("slot_id")).agg(F.min(F.when(F.col("l_suppkey") % 4 != 0, F.col("l_partkey"))).alias("chosen_id"), F.min("l_quantity").alias("start_sec"), (F.min("l_quantity") + 30.0).alias("end_sec"))
    part = table(spark, sf_dir, "part")
    return sl.chosen_overlays(chosen, part.filter("p_size <> 7").select(F.col("p_partkey").alias("candidate_id"), F.when(F.col("p_size") > 3, F.col("p_partkey")).alias("asset_id")), part.select(F.col("p_partkey").alias("asset_id"), F.col("p_size").cast("double").alias("duration_sec")))


J13 = """WITH c AS (SELECT l_suppkey AS slot_id, min(CASE WHEN l_suppkey % 4 <> 0 THEN l_partkey END) AS p, min(l_quantity) AS s FROM lineitem GROUP BY 1)
SELECT slot_id, p AS asset_id, 0.0::DOUBLE AS start_sec, round(least(30.0, p_size::DOUBLE), 3) AS end_sec, round(s, 3) AS timeline_start_sec FROM c JOIN part ON p_partkey = p WHERE p_size <> 7 AND p_size > 3"""


def r10_slot_states(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("slot_id"), F.col("o_orderkey").alias("choice_id"), (F.col("o_orderkey") * 3).alias("candidate_id"), F.when(F.col("o_orderstatus") == "F", "reject").when(F.col("o_orderstatus") == "O", "lock").otherwise("choose").alias("action"))
    return sl.slot_states(o)


R10 = """WITH o AS (SELECT o_custkey AS slot_id, arg_max(CASE WHEN o_orderstatus = 'P' THEN o_orderkey * 3 ELSE -1 END, o_orderkey) FILTER (o_orderstatus <> 'O') AS c, bool_or(o_orderstatus = 'O') AS locked FROM orders GROUP BY 1)
SELECT slot_id, CASE WHEN c IS NULL THEN 'pending' WHEN c >= 0 THEN 'chosen' ELSE 'rejected' END AS status, CASE WHEN c >= 0 THEN c END AS candidate_id, locked FROM o"""


def u1_u3_u4_sets(spark, sf_dir):
    """Ranges that are silences or errors, words of clicks without those of odd ids, and those of both."""
    w = words(spark, sf_dir)
    union = silences(w).drop("_slice").unionByName(w.filter("text = 'error'").select("key", "start_sec", "end_sec")).distinct().agg(F.count("*").alias("united"))
    ids = w.select("word_id", "text")
    clicks, odd = ids.filter("text = 'click'").select("word_id"), ids.filter("word_id % 2 = 1").select("word_id")
    return union.crossJoin(clicks.subtract(odd).agg(F.count("*").alias("less"))).crossJoin(clicks.intersect(odd).agg(F.count("*").alias("both")))


U1 = f"WITH {WORDS}, u AS (SELECT key, start_sec, end_sec FROM silences UNION SELECT key, start_sec, end_sec FROM words WHERE text = 'error') SELECT (SELECT count(*) FROM u) AS united, count(*) FILTER (word_id % 2 = 0) AS less, count(*) FILTER (word_id % 2 = 1) AS both FROM words WHERE text = 'click'"


def u2_ordered_union(spark, sf_dir):
    """All words, and the errors once more half a second later, in one order."""
    w = words(spark, sf_dir).select("key", "text", "start_sec", "end_sec")
    again = w.filter("text = 'error'").withColumns({"start_sec": F.col("start_sec") + 0.5, "end_sec": F.col("end_sec") + 0.5})
    rows = spread(w.unionByName(again), "start_sec", "end_sec", "text")
    placed = scanned(rows, ["start_sec", "end_sec", "text"], {"place": so_far("sum", F.lit(1))})
    return placed.select("key", F.col("place").cast("int").alias("place"), "text", F.round("start_sec", 3).alias("start_sec"))


U2 = f"""WITH {WORDS}, u AS (SELECT key, text, start_sec, end_sec FROM words UNION ALL SELECT key, text, start_sec + 0.5, end_sec + 0.5 FROM words WHERE text = 'error')
SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY start_sec, end_sec, text) AS INT) AS place, text, round(start_sec, 3) AS start_sec FROM u"""


def f8_f9_candidate_text(spark, sf_dir):
    """Events as candidates whose metadata is a document five levels deep around their own properties."""
    e = table(spark, sf_dir, "events")
    nested = F.concat(F.lit('{"k": {"z": [1, {"c": ["x", {"d": '), F.col("props"), F.lit('}, []]}], "a": true}, "none": null, "last": "{\\"not\\": 1}"}'))
    rows = documents.with_json_text(e.select("event_id", "event_type", nested.alias("meta")), "event_id", "meta")
    url, name = F.concat(F.lit("https://v.example.com/a/"), F.col("event_id").cast("string"), F.lit("?x=1")), F.concat("event_type", F.lit(".mp4"))
    text = tx.candidate_text(F.col("event_type"), F.lit("project_asset"), F.lit("a query"), url, F.array(F.lit("hit")), F.lit("page.example.com"), F.array(F.lit("tag"), F.lit("team")), name, F.col("json_text"))
    return rows.select("event_id", text.alias("text"), F.round(tx.token_overlap(F.array(F.lit("view"), F.lit("hit")), tx.tokens(text)), 3).alias("overlap"))


F8 = """SELECT event_id, event_type || ' project_asset a query page.example.com tag team hit v.example.com a ' || event_id || ' ' || event_type || '.mp4 1 x ' || json_extract_string(props, '$.k') || ' True {"not": 1}' AS text,
  CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.5 END::DOUBLE AS overlap FROM events"""


def a9_a12_a13_counts(spark, sf_dir):
    w = words(spark, sf_dir).join(durations(words(spark, sf_dir)), "key")
    kept = F.col("word_id") % 3 != 0
    return w.groupBy("key").agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("removed"), F.round(F.greatest(F.lit(0.0), F.first("duration_sec") - F.sum(F.when(kept, F.col("end_sec") - F.col("start_sec")))), 3).alias("removed_sec"))


A9 = f"WITH {WORDS} SELECT key, count(*) FILTER (word_id % 3 <> 0) AS kept, count(*) FILTER (word_id % 3 = 0) AS removed, round(greatest(0.0, any_value(duration_sec) - sum(CASE WHEN word_id % 3 <> 0 THEN end_sec - start_sec END)), 3) AS removed_sec FROM words JOIN durations USING (key) GROUP BY key"


def v8_block_toggle(spark, sf_dir):
    w = words(spark, sf_dir).select("key", "seq", (F.col("text") == "view").alias("deleted"))
    blocks = w.groupBy("key").agg(F.lit(3).alias("first_seq"), F.lit(4).alias("last_seq")).filter("key % 2 = 0")
    return sl.block_toggled(w, blocks)


V8 = f"""WITH {WORDS}, w AS (SELECT key, seq, text = 'view' AS deleted FROM words), b AS (SELECT key, bool_and(deleted) AS d FROM w WHERE seq BETWEEN 3 AND 4 AND key % 2 = 0 GROUP BY key)
SELECT w.key, CAST(seq AS INT) AS seq, CASE WHEN seq BETWEEN 3 AND 4 AND b.key IS NOT NULL THEN NOT d ELSE deleted END AS deleted FROM w LEFT JOIN b ON b.key = w.key"""


def e7_reusable(spark, sf_dir):
    w = words(spark, sf_dir)
    n = durations(w).join(w.groupBy("key").agg(F.count("*").alias("n")), "key", "left")
    return n.select("key", sl.reusable(F.coalesce("n", F.lit(0)), least_words(F.col("duration_sec") / 20000), F.col("key") % 2 == 0).alias("reuse"))


E7 = f"WITH {WORDS} SELECT d.key, (SELECT count(*) FROM words w WHERE w.key = d.key) > 0 AND (d.key % 2 <> 0 OR (SELECT count(*) FROM words w WHERE w.key = d.key) >= greatest(8, CAST(round_even(greatest(duration_sec / 20000, 1.0) * 0.45, 0) AS INT))) AS reuse FROM durations d"


def e13_ensured_assets(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("project_id"), F.col("l_partkey").alias("asset_id"), F.lit(0.0).alias("start_sec"), F.col("l_quantity").alias("end_sec"))
    wanted = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("project_id"), (F.col("s_suppkey") * 3).alias("asset_id"), F.col("s_acctbal").alias("duration_sec"))
    return sl.with_missing_assets(line, wanted)


E13 = """SELECT l_suppkey AS project_id, l_partkey AS asset_id, 0.0::DOUBLE AS start_sec, l_quantity AS end_sec FROM lineitem
UNION ALL SELECT s_suppkey, s_suppkey * 3, 0.0, round(s_acctbal, 3) FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_partkey = s_suppkey * 3)"""


def w24_audible(spark, sf_dir):
    """Lines as clips on tracks by line status, orders as projects: which sound, and how loud."""
    line = table(spark, sf_dir, "lineitem")
    tracks = line.groupBy(F.col("l_orderkey").alias("project_id"), F.col("l_linestatus").alias("track")).agg((F.max("l_discount") > 0.08).alias("solo"), (F.min("l_tax") < 0.01).alias("mute"), F.lit(0.5).alias("volume"))
    clips = line.select(F.col("l_orderkey").alias("project_id"), F.col("l_linestatus").alias("track"), "l_partkey", (F.col("l_tax") > 0.06).alias("mute"), F.col("l_quantity").alias("volume"))
    return sl.audible(tracks, clips).groupBy("project_id", "track").agg(F.count("*").alias("n"), F.round(F.sum("volume"), 3).alias("volume"))


W24 = """WITH t AS (SELECT l_orderkey AS p, l_linestatus AS k, max(l_discount) > 0.08 AS solo, min(l_tax) < 0.01 AS mute FROM lineitem GROUP BY 1, 2), a AS (SELECT p, k, CASE WHEN bool_or(solo) OVER (PARTITION BY p) THEN solo ELSE NOT mute END AS sounds FROM t)
SELECT p AS project_id, k AS track, count(*) AS n, round(sum(CASE WHEN l_tax > 0.06 THEN 0.0 ELSE l_quantity * 0.5 END), 3) AS volume FROM a JOIN lineitem ON l_orderkey = p AND l_linestatus = k WHERE sounds GROUP BY 1, 2"""

QUERIES = {
    "u2_ordered_union": (u2_ordered_union, U2),
    "s1_s2_scans": (s1_s2_scans, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "s4_projects": (s4_projects, S4),
    "p8_low_confidence": (p8_low_confidence, P8),
    "p12_p14_labels": (p12_p14_labels, P12),
    "p16_settings": (p16_settings, P16),
    "j6_slot_texts": (j6_slot_texts, J6),
    "j13_chosen_overlays": (j13_chosen_overlays, J13),
    "r10_slot_states": (r10_slot_states, R10),
    "u1_u3_u4_sets": (u1_u3_u4_sets, U1),
    "u5_f8_f9_candidate_text": (f8_f9_candidate_text, F8),
    "a9_a12_a13_counts": (a9_a12_a13_counts, A9),
    "v8_block_toggle": (v8_block_toggle, V8),
    "e7_reusable": (e7_reusable, E7),
    "e13_ensured_assets": (e13_ensured_assets, E13),
    "w24_audible_tracks": (w24_audible, W24),
}
